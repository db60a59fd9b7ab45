"""What the models of problem 3 are fitted on besides the texts themselves: residue, and ordinary prose beside it.

Alternatives stand in braces, separated by bars, an empty one included. Patterns are grouped into families, one a line,
so that a family can be left out and recognised by the others.
"""

from __future__ import annotations

import itertools
import re

import numpy as np

#: Stand-in text: something else was to be written here.
STAND_IN = """
{Description|Product description|Item description|Details|Text|Content|More information|Product details|Copy} {coming soon|to follow|to come|will follow|follows soon|follows shortly|pending|to be added|to be provided|to be confirmed|to be supplied}{.|}
{No|There is no|Currently no} {description|product description|text|content|information|details|item description} {available|is available|provided|yet|has been added|has been written yet|has been entered|at this time|found}{.|}
{Description|Product description|Information|Content|Text|Details} {is |}{not available|unavailable|missing|not yet available|not provided|not entered|currently not available|not specified}{ at this time|}{.|}
{The |This |}{description|text|content|section|product text} {will be added|will be available|will be updated|will be provided|has not been written|is being written|is still being prepared|is under construction|has yet to be written} {soon|later|shortly|here}{.|}
{To be|TO BE} {added|determined|announced|completed|defined|confirmed|written|DETERMINED|ADDED}{.|}
{TBD|TBA|TBC|TODO|TODO: write description|TODO: add text|FIXME|N/A|n/a|N.A.|WIP|tbd|tba|todo}
{This is |}{placeholder|Placeholder|dummy|Dummy|sample|Sample|filler|Filler|example|Example|temporary|Temporary} {text|copy|content|description|paragraph|entry}{, do not publish|, please replace|, please replace before publishing| for testing| only| to be replaced| goes here|, replace me|}{.|}
{Replace|Please replace|Change|Edit|Please edit|Delete|Overwrite|Remove} this {text|placeholder|copy|content|paragraph|description|sample text|dummy text|line} {before publishing|with your own|with the real description|before going live|later|before launch}{.|}
{Insert|Enter|Add|Type|Write|Put|Paste|Provide|Place} {your|a|the|some|product|item} {description|text|product description|content|product text|details|copy|short description|item description} {here|in this box|in this field|below|before publishing}{.|}
{Your|Product|Item|Some|The} {text|description|content|copy|title|story|product description|headline} {here|goes here|should go here|will appear here|will be shown here|will go here|belongs here}{.|}
{Write|Say|Tell us|Enter} {something|a few words|a sentence|a short text} about {this|your|the} {product|item|article} here{.|}
{Click here|Click|Double click|Tap} to {edit|add|change|enter} {this text|text|your text|a description|the description}{.|}
{test|Test|TEST|testing|test test|Test test test|testtest|test product|Test product|test item|test entry|This is a test|This is only a test|This is a test entry|This is a test product}{ please ignore| do not buy| do not order| 1| 123|}{.|}
{asdf|asdf asdf|asdf asdf asdf|asdfgh|asdfghjkl|asdf jkl|qwerty|qwerty qwerty|qwertz|qwer asdf|asdf qwer|hjkl|jkjk|xxx|xxx xxx|xxxxx|xxxx xxxx xxxx|aaa aaa|abc abc abc|abc def ghi|foo bar|foo bar baz|blah blah|blah blah blah|bla bla bla|yada yada|1234 test|aaaa|zzzz|12345|new product|New product|Untitled|untitled|Untitled product|No title|dummy|Dummy product|sample|Sample product|example product}
{Some|The quick|Random} {random|sample|dummy} {words|text} to fill {the|this} {space|field|page}{.|}
{Beschreibung|Produktbeschreibung|Text|Artikelbeschreibung|Produkttext|Inhalt} {folgt|folgt in Kürze|folgt noch|folgt bald|wird noch ergänzt|wird nachgereicht|fehlt|fehlt noch|in Arbeit|in Vorbereitung}{.|}
{Keine|Noch keine|Derzeit keine} {Beschreibung|Produktbeschreibung|Angaben|Informationen} {vorhanden|verfügbar|hinterlegt}{.|}
{Hier|Bitte hier} {den Text|eine Beschreibung|Ihren Text|die Produktbeschreibung|den Inhalt} {einfügen|eingeben|eintragen|ergänzen}{.|}
{Platzhaltertext|Platzhalter|Beispieltext|Blindtext|Mustertext|Testtext|Testartikel|Testprodukt|Dies ist ein Blindtext|Dies ist ein Test|Hier steht bald ein Text|Hier steht später die Beschreibung}{, bitte ersetzen|, bitte nicht kaufen|, wird noch ersetzt|}{.|}
{Description|Texte|Descriptif|Contenu|Fiche produit} {à venir|bientôt disponible|à compléter|à ajouter|à rédiger|en cours de rédaction|à remplacer|manquante|non disponible|indisponible}{.|}
{Aucune|Pas de|Pas encore de} {description|description disponible|information|information disponible|fiche}{.|}
{Insérez|Insérer|Saisissez|Saisir|Ajoutez|Écrivez|Entrez} {votre|le|ici le|ici votre|une} {texte|description|texte ici|description ici|contenu ici}{.|}
{Texte d'exemple|Texte de remplissage|Texte provisoire|Faux texte|Exemple de texte|Ceci est un texte d'exemple|Ceci est un test|Produit de test}{ à remplacer|, ne pas acheter|, à remplacer avant publication|}{.|}
{Descripción|Texto|Contenido|Descripción del producto} {pendiente|próximamente|por añadir|pendiente de añadir|no disponible|en preparación|por completar|por definir}{.|}
{Sin|No hay|Aún no hay} {descripción|descripción disponible|información|texto|contenido}{.|}
{Inserte|Introduzca|Escriba|Añada|Ingrese} {aquí|su|la|el} {texto|descripción|el texto|la descripción|su texto} {aquí|}{.|}
{Texto de ejemplo|Texto de relleno|Texto provisional|Texto de prueba|Esto es un texto de ejemplo|Esto es una prueba|Producto de prueba}{, sustituir antes de publicar|, no comprar|, reemplazar|}{.|}
{Descrizione|Testo|Contenuto|Descrizione del prodotto} {in arrivo|da aggiungere|da inserire|da completare|non disponibile|mancante|in preparazione}{.|}
{Nessuna descrizione|Nessun testo|Nessuna informazione} {disponibile|presente|inserita}{.|}
{Inserire|Inserisci|Scrivi|Aggiungere} {qui il testo|qui la descrizione|il testo qui|la descrizione qui|il tuo testo qui}{.|}
{Testo di esempio|Testo segnaposto|Testo di prova|Questo è un testo di prova|Prodotto di prova}{, da sostituire|, non acquistare|}{.|}
{Descrição|Texto|Conteúdo|Descrição do produto} {em breve|a adicionar|a definir|por adicionar|não disponível|indisponível|em preparação|pendente}{.|}
{Nenhuma descrição|Sem descrição|Nenhum texto} {disponível|cadastrada|ainda}{.|}
{Insira|Digite|Escreva|Adicione} {o texto aqui|a descrição aqui|aqui o texto|aqui a descrição|seu texto aqui}{.|}
{Texto de exemplo|Texto provisório|Texto de teste|Este é um texto de exemplo|Produto de teste}{, substituir antes de publicar|, não comprar|}{.|}
{Описание|Текст|Описание товара|Информация} {скоро появится|будет добавлено|будет добавлено позже|отсутствует|пока отсутствует|в разработке|готовится|появится позже}{.|}
{Вставьте|Введите|Добавьте|Напишите|Впишите} {текст|описание|здесь текст|сюда текст|сюда описание|описание товара} {сюда|здесь|}{.|}
{Текст-заглушка|Пример текста|Тестовый текст|Тестовый товар|Это тестовый текст|Образец текста}{, замените перед публикацией|, не покупать|, заменить|}{.|}
{説明|商品説明|説明文|商品の説明|詳細|本文}{は近日公開予定です|は準備中です|はまだありません|は後日追加します|はありません|準備中|は後ほど掲載します|は未入力です}{。|}
{ここに|こちらに}{説明|文章|テキスト|商品説明|本文}を{入力してください|入れてください|書いてください|記入}{。|}
{ダミーテキストです|ダミー文章です|サンプルテキスト|テスト商品です|これはテストです|仮のテキストです}{。|}
{描述|商品描述|产品说明|详情}{即将推出|稍后添加|暂无|待补充|尚未添加}{。|}
{在此输入文字|请在此处输入描述|示例文本，请替换|占位文本|测试商品，请勿购买}{。|}
{Beschrijving|Tekst} {volgt|volgt binnenkort|niet beschikbaar|nog toe te voegen}{.|}
{Opis|Tekst} {wkrótce|zostanie dodany|niedostępny|w przygotowaniu}{.|}
"""
#: Error messages of pages and programs.
ERRORS = """
{404|Error 404|HTTP 404|Error: 404|404 error|HTTP error 404|Status 404}{ Not Found| - Page not found|: page not found| - File or directory not found|: the page was not found|}{.|}
{400|401|403|405|408|410|418|429|500|501|502|503|504}{ | - |: | Error - | Error: }{Bad Request|Unauthorized|Forbidden|Method Not Allowed|Request Timeout|Gone|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Service Temporarily Unavailable|Gateway Timeout|Gateway Time-out}{.|}
{HTTP|HTTP status|HTTP error|Error|Error code|Status code|Code}{: | |}{400|401|403|404|418|429|500|502|503|504|1020|522}
{The |This |}{page|file|product|item|URL|address|listing|resource|document} {you requested|you are looking for|you asked for|you were looking for|} {could not be found|cannot be found|was not found|does not exist|no longer exists|has been removed|has been moved|is no longer available|could not be loaded|is not available}{ on this server|}{.|}
{Page|File|Item|Resource|Product|Listing} not found{.|}
{Sorry, |Oops! |Oops, |We're sorry, |We are sorry, |Uh oh, |Whoops, |}{something went wrong|an error occurred|an error has occurred|an unexpected error occurred|there was a problem|we could not process your request|we can't find that page|this page isn't working|we couldn't load this page|an unknown error occurred}{ on our side| on our end| while loading this page| while loading the item| processing your request|}{.|}
{Please |}{try again|try again later|try again in a few minutes|try again shortly|come back later|refresh the page|reload the page|contact the administrator|contact support|go back and try again|wait and retry|retry in 30 seconds|wait 60 seconds}{.|}
{Internal server error|Server error|Application error|Runtime error|Unexpected error|Unknown error|System error|Script error|Database error|Connection error|Network error|Parse error|Syntax error|Fatal error|Render error|Template error|Rendering error}{ in line 12| at line 3| occurred|: null| in '/' application| while rendering|}{.|}
{The |This |}{service|server|site|website|page|system|shop} is {temporarily |currently |}{unavailable|down for maintenance|overloaded|offline|not responding|too busy}{. Please try again later|}{.|}
{The |}{request|connection|operation|gateway|session|server|query|upstream} {timed out|has timed out|was reset|was refused|has expired|was aborted|failed|was closed|took too long to respond}{ while loading this listing| while loading this page| after 30 seconds|}{.|}
{Access|Permission|Request|Login|Authentication|Authorization} {denied|failed|required|blocked|refused|rejected}{: you have no permission|: your session has expired|: please sign in|: invalid token| for this resource|}{.|}
{You|You do} {don't have|do not have|have no} {permission|access|authorization|rights} to {view|access|see|open} this {page|resource|item|content|file}{ on this server|}{.|}
{Your |The |This |}{session|login|link|token} {has expired|has timed out|is no longer valid|was invalid|expired}{, sign in again|, please log in again|. Please sign in again|}{.|}
{Please|You must|You need to|Please go back and} {log in|sign in|log in again|sign in again|authenticate} to {continue|view this page|see this content|proceed}{.|}
{Too many|Rate limit: too many} {requests|attempts|connections}{ from your address| from this IP|, wait 30 seconds|, slow down|. Please slow down|. Try again later|}{.|}
{Bad|Invalid|Malformed|Illegal|Unsupported} {request|parameter|argument|item reference|id|response|input|URL|reference|product id|token}{: invalid item reference| (invalid reference)|: missing id|}{.|}
{Could not|Cannot|Can't|Failed to|Unable to|Error: could not|Error: failed to} {connect to|load|fetch|open|read|retrieve|render|find|parse|reach} {the database|the server|the page|the resource|data|the item|the template|the description|the file|the product|the content|the requested page|item data}{.|}
{Uncaught|Unhandled|Fatal error: Uncaught|} {TypeError|ReferenceError|SyntaxError|RangeError|Error|Exception|RuntimeException|NullReferenceException|ValueError|KeyError|AttributeError|IndexError}: {cannot read property 'name' of undefined|x is not defined|undefined is not a function|null is not an object|'title'|'NoneType' object has no attribute 'text'|unexpected token|list index out of range|object reference not set to an instance of an object|null value|invalid syntax|value is null}
{java.lang.NullPointerException|NullPointerException|java.lang.IllegalStateException|java.io.IOException|org.view.RenderException|RenderException|TemplateException|com.shop.view.Error|System.NullReferenceException|ServletException|StackOverflowError|OutOfMemoryError|ArrayIndexOutOfBoundsException}{: null value|: stream closed|: template not found|} {at com.shop.view.Item.render(Item.java:42)|at item.view line 17|at view.render line 110|at main.js:12|at catalog.view line 9|in module item|at index.php:20|}
Traceback (most recent call last): File "{view|app|main|item}.py", line {12|40|7}, in {render|main|get|load}
{Warning|Notice|Fatal error|Deprecated|Parse error|PHP Warning|PHP Notice}: {undefined variable|undefined index|call to undefined function|division by zero|unexpected end of file|include failed|file not found|Undefined offset}{: name| in index.php| in item.php|} on line {12|20|7|103}
{You have an error in your |}{SQL|SQL syntax|MySQL|ORA-00942|SQLSTATE[42000]}{: | }{error|syntax error|table or view does not exist|server has gone away|syntax error near '' at line 1|connection refused}{.|}
{undefined|null|NaN|[object Object]|None|(null)|#N/A|#REF!|#VALUE!|ERR_CONNECTION_REFUSED|ERR_TIMED_OUT|ECONNRESET|segmentation fault|core dumped|stack trace|undefined undefined|null null}
{Fehler|Fehlercode|Fehler:|Fehler 404:|Fehler 500:|Fehler 503:|Ein Fehler ist aufgetreten:|Entschuldigung,} {Die Seite wurde nicht gefunden|Seite nicht gefunden|Die Seite konnte nicht geladen werden|Interner Serverfehler|Zugriff verweigert|Dienst nicht verfügbar|Zeitüberschreitung|Der Artikel konnte nicht geladen werden|etwas ist schiefgelaufen}{.|}
{Bitte versuchen Sie es später erneut|Bitte versuchen Sie es später noch einmal|Bitte laden Sie die Seite neu|Bitte melden Sie sich erneut an|Ihre Sitzung ist abgelaufen|Die angeforderte Seite existiert nicht|Die angeforderte Seite wurde nicht gefunden|Der Server ist nicht erreichbar|Verbindung zur Datenbank fehlgeschlagen|Zu viele Anfragen}{.|}
{Erreur|Erreur :|Erreur 404 :|Erreur 500 :|Erreur 503 :|Désolé,|Oups,} {page introuvable|la page demandée est introuvable|la page demandée n'existe pas|erreur interne du serveur|accès refusé|service indisponible|impossible de charger la page|une erreur est survenue|une erreur s'est produite|délai d'attente dépassé}{.|}
{Veuillez réessayer plus tard|Veuillez recharger la page|Votre session a expiré|Veuillez vous reconnecter|Impossible de se connecter à la base de données|Impossible d'afficher la page|Le serveur ne répond pas|Trop de requêtes}{.|}
{Error|Error:|Error 404:|Error 500:|Error 503:|Lo sentimos,|Ups,} {página no encontrada|no se encontró la página|no se pudo cargar la página|error interno del servidor|acceso denegado|servicio no disponible|ha ocurrido un error|se ha producido un error|la página solicitada no existe|tiempo de espera agotado}{ solicitada|}{.|}
{Inténtelo de nuevo más tarde|Vuelva a intentarlo más tarde|Su sesión ha caducado|Inicie sesión de nuevo|No se pudo conectar con el servidor|No se pudo conectar a la base de datos|Demasiadas solicitudes|Recargue la página}{.|}
{Errore|Errore:|Errore 404:|Errore 500:|Spiacenti,|Ops,} {pagina non trovata|la pagina richiesta non esiste|impossibile caricare la pagina|errore interno del server|accesso negato|servizio non disponibile|si è verificato un errore|tempo scaduto}{ richiesta|}{.|}
{Riprova più tardi|Riprovare più tardi|La sessione è scaduta|Accedi di nuovo|Impossibile connettersi al server|Impossibile caricare la pagina richiesta|Troppe richieste}{.|}
{Erro|Erro:|Erro 404:|Erro 500:|Desculpe,|Ops,} {página não encontrada|a página solicitada não existe|não foi possível carregar a página|erro interno do servidor|acesso negado|serviço indisponível|ocorreu um erro|tempo esgotado}{ solicitada|}{.|}
{Tente novamente mais tarde|Por favor, tente novamente|Sua sessão expirou|Faça login novamente|Não foi possível conectar ao servidor|Muitas solicitações|Recarregue a página}{.|}
{Ошибка|Ошибка:|Ошибка 404:|Ошибка 500:|Ошибка 503:|Извините,} {страница не найдена|запрошенная страница не найдена|не удалось загрузить страницу|внутренняя ошибка сервера|доступ запрещён|сервис недоступен|произошла ошибка|что-то пошло не так|время ожидания истекло|такой страницы не существует}{.|}
{Попробуйте позже|Повторите попытку позже|Обновите страницу|Ваша сессия истекла|Войдите снова|Не удалось подключиться к серверу|Не удалось загрузить данные|Слишком много запросов|Пожалуйста, попробуйте ещё раз}{.|}
{エラー|エラー：|エラー404：|404エラー：|エラー500：|申し訳ありません、|}{ページが見つかりません|お探しのページは見つかりませんでした|ページを読み込めませんでした|サーバーエラーが発生しました|内部サーバーエラー|アクセスが拒否されました|エラーが発生しました|タイムアウトしました|サービスを利用できません|ページを表示できません}{でした|}{。|}
{しばらくしてからもう一度お試しください|後でもう一度お試しください|もう一度ログインしてください|セッションの有効期限が切れました|ページを再読み込みしてください|サーバーに接続できません|リクエストが多すぎます}{。|}
{错误404：页面未找到|页面不存在|内部服务器错误|拒绝访问|请稍后再试|服务不可用|加载失败|会话已过期，请重新登录}{。|}
{Fout 404: pagina niet gevonden|Er is een fout opgetreden|Probeer het later opnieuw|Błąd 404: nie znaleziono strony|Wystąpił błąd|Spróbuj ponownie później}{.|}
"""
#: Notices that scripts (or cookies, or another browser) are required.
SCRIPTS = """
{Please |You must |You need to |You have to |Kindly |}{enable|activate|turn on|allow|switch on|Enable|Activate|Turn on|Allow} {JavaScript|Javascript|scripts|scripting|JS|cookies|JavaScript and cookies|client-side scripting}{ in your browser| in your browser settings|} {to|in order to} {view|see|use|load|display|continue to|access|read|run} {this page|this site|the content|this content|the description|this app|this shop|the page|this listing}{ properly| correctly|}{.|}
{Please |}{enable|activate|turn on|allow|Enable|Activate|Turn on} {JavaScript|scripts|scripting|cookies|JavaScript and cookies}{ in your browser|}{ and reload| and reload the page| and try again| to continue|}{.|}
{JavaScript|Javascript|Scripting|Script support|JS} is {disabled|turned off|switched off|not enabled|not available|blocked|required|not supported|deactivated}{ in your browser| for this page| to view this page| to display this content| to use this site|}{.|}
{Scripts|Cookies|Scripts and cookies|Active scripts} are {disabled|turned off|switched off|blocked|required|not allowed|not enabled|needed}{ in your browser| for this page| here|}{.|}
{Turn|Switch} {them|scripts|JavaScript|scripting} {on|back on} and {reload|reload the page|refresh|try again|refresh the page}{.|}
{This|The|Our} {site|page|website|shop|app|store|content|listing|description} {requires|needs|only works with|does not work without|won't work without|relies on|uses} {JavaScript|scripts|scripts and cookies|JavaScript and cookies|JavaScript to be enabled|scripting|a browser with JavaScript}{ to work| to work properly| to function| to run|}{.|}
{Your|This|The} browser {does not support|doesn't support|has disabled|blocks|is not able to run|cannot run|does not run|has turned off} {JavaScript|scripts|scripting|this feature|cookies|frames|the video tag|HTML5 video}{, so this content can't be shown|, so the page can't be shown| or it is disabled| or they are switched off|}{.|}
{noscript|NOSCRIPT|No script|no-script}{: | - }{content unavailable|content not shown|enable JavaScript|dynamic content unavailable|please enable scripts|this content needs scripts}{.|}
{Dynamic|Interactive|This|Some} content {unavailable|is unavailable|cannot be shown|can't be displayed|is not shown|cannot be displayed} without {scripts|JavaScript|scripting|cookies}{.|}
{Without|If you disable} {JavaScript|scripts|scripting|cookies}{,|} {this page cannot be displayed|the content can't be shown|the site will not work|this site does not work|you cannot see this page}{.|}
{Please update|Please upgrade|You should update|Update} your browser{ to view this page| to continue|}{.|}
{Checking your browser|Verifying you are human|Please wait while we verify your browser|Please verify that you are not a robot}{ before accessing the site|. This may take a few seconds|}{.|}
{Bitte aktivieren Sie|Bitte schalten Sie|Aktivieren Sie|Sie müssen} {JavaScript|Skripte|JavaScript in Ihrem Browser|Cookies|Scripting}{ ein| aktivieren|}{, um diese Seite zu sehen|, um fortzufahren|, um diesen Inhalt anzuzeigen|, um die Beschreibung zu sehen|}{.|}
{Diese Seite|Dieser Shop|Diese Website|Dieser Inhalt|Die Beschreibung} {benötigt|erfordert|braucht|funktioniert nur mit} {JavaScript|Skripte|JavaScript und Cookies}{.|}
{JavaScript ist deaktiviert|Skripte sind deaktiviert|Ihr Browser unterstützt keine Skripte|Ihr Browser unterstützt kein JavaScript|Ohne JavaScript kann der Inhalt nicht angezeigt werden}{.|}
{Veuillez activer|Merci d'activer|Activez|Vous devez activer} {JavaScript|les scripts|les cookies|JavaScript dans votre navigateur}{ pour afficher cette page| pour voir ce contenu| pour continuer| pour afficher ce contenu|}{.|}
{Ce site|Cette page|Cette boutique|Ce contenu|Cette application} {nécessite|requiert|a besoin de|ne fonctionne pas sans} {JavaScript|scripts|scripts et cookies|cookies}{.|}
{JavaScript est désactivé|Les scripts sont désactivés|Votre navigateur ne prend pas en charge les scripts|Votre navigateur ne prend pas en charge JavaScript|Contenu indisponible sans scripts}{.|}
{Active|Activa|Por favor, active|Habilite|Debe activar|Por favor habilite} {JavaScript|los scripts|las cookies|JavaScript en su navegador}{ para ver esta página| para ver la descripción| para continuar| para mostrar este contenido|}{.|}
{Este sitio|Esta página|Esta tienda|Este contenido} {requiere|necesita|no funciona sin} {JavaScript|scripts|JavaScript y cookies}{.|}
{JavaScript está desactivado|Los scripts están desactivados|Su navegador no admite scripts|Su navegador no es compatible con JavaScript}{.|}
{Attiva|Attivare|Abilita|Abilitare|È necessario attivare} {JavaScript|gli script|i cookie|JavaScript nel browser}{ per visualizzare questa pagina| per vedere il contenuto| per continuare|}{.|}
{Questo sito|Questa pagina|Questo negozio} {richiede|necessita di|non funziona senza} {JavaScript|script|script e cookie}{.|}
{JavaScript è disattivato|Gli script sono disattivati|Il browser non supporta gli script|Il tuo browser non supporta JavaScript}{.|}
{Ative|Habilite|Por favor, ative|É preciso ativar} {o JavaScript|JavaScript|os scripts|os cookies}{ para ver esta página| para ver o conteúdo| para continuar| no seu navegador|}{.|}
{Este site|Esta página|Esta loja} {requer|precisa de|não funciona sem} {JavaScript|scripts|scripts e cookies}{.|}
{O JavaScript está desativado|Os scripts estão desativados|Seu navegador não suporta scripts|O seu navegador não suporta JavaScript}{.|}
{Включите|Пожалуйста, включите|Разрешите|Активируйте|Необходимо включить} {JavaScript|скрипты|JavaScript в браузере|скрипты в браузере|cookies}{, чтобы увидеть эту страницу|, чтобы продолжить|, чтобы увидеть описание| для просмотра страницы|}{.|}
{Для работы сайта|Для этой страницы|Для просмотра|Этому сайту} {нужен JavaScript|необходим JavaScript|нужны скрипты|требуется JavaScript|нужны скрипты и cookies}{.|}
{JavaScript отключён|Скрипты отключены|Ваш браузер не поддерживает скрипты|Ваш браузер не поддерживает JavaScript}{.|}
{このページを|このサイトを|この内容を|コンテンツを|説明を}{表示|利用|閲覧|ご覧になる}{するには|には}{JavaScript|スクリプト|Cookie}{を有効にしてください|が必要です}{。|}
{JavaScriptが無効になっています|スクリプトが無効です|JavaScriptを有効にしてください|ブラウザがスクリプトに対応していません|スクリプトを有効にして再読み込みしてください}{。|}
{请启用JavaScript|请在浏览器中启用JavaScript以查看此页面|您的浏览器不支持脚本|此网站需要JavaScript}{。|}
{Schakel JavaScript in om deze pagina te bekijken|Deze site vereist JavaScript|Włącz JavaScript, aby zobaczyć tę stronę}{.|}
"""
#: Ordinary sentences, many with words that residue has as well, and sentences that only speak of such things.
ORDINARY = """
{This cable|The new valve|The spare lid|This part} replaces {a broken lead|the worn one|the old seal} {in a few minutes|without tools|at once}.
{Add|Pour in|Mix in} {hot water|a spoon of sugar|the powder|two eggs} and {wait five minutes|stir well|let it rest}.
{Insert|Put in|Place} the {batteries|key|cartridge|tablets} and {close the cover|turn it to the left|press the button}.
{Enter|Type in} the {code|number} {on the keypad|printed on the card|and the door opens}.
Error-free {typing|reading|measuring} thanks to {quiet keys|large digits|a clear screen}.
{The|A|This|Our} {poster|mug|sign|shirt|sticker|print|card|doormat} {says|reads|shows|bears the words} {page not found|error 404|access denied|lorem ipsum|coming soon|under construction|to be continued|out of order|please wait} {in large letters|on the front|in gold letters|on one side|above a drawing|in white on black}.
{This|The|Our} {book|course|guide|manual|video} {shows|explains|tells|teaches} {how|why} {JavaScript pages behave when scripts are off|servers fail and sessions expire|a browser loads its pages|error messages come about|to enable scripts in a browser|to write a good description|web shops handle errors|placeholder text came into use}.
{A|The|This} {lamp|tester|meter|alarm|panel} {has|with|comes with} an error light that {turns red on a fault|blinks when the filter is full|shows a broken fuse|goes on when the battery is empty}.
{The|This|Each} {template|stencil|form|label|notebook|kit} {set|pad|pack|} has {ten blank fields|twelve empty lines|space for your name|a field for the date} to {fill in by hand|write on|fill in}.
{We|Our workshop} {engrave|print|stamp} {the words of your choice|your text|your name|any short text} {here|on the back|on the lid}, up to {20|30|12} letters.
{Your|The} {name|text|photo} {goes|is printed|appears} on the {back|front|lid} {of the mug|in dark ink|as you wish it}.
{Save|You save} $ {5|10|20} {with|on} the {S, M, L|three-part|family} {bundle|set|offer}.
The {dummy|sample|test} {battery|bottle|piece|weight} {is included|shows the true size|helps you to choose} {in the box|before you order|for free}.
{A|The} {blank|plain|sample} {page|sheet|card} {for each day|with wide lines|comes with every order}.
{Try|Please try} {it|them|the fit} {on at home|with warm water|first on a small spot}.
The {server|waiter|cook|host} {carries|finds|brings} {six plates|the tray|hot soup} {with one hand|at once|to the table}.
{This|The} {page|sheet|booklet|folder} {turner|marker|holder} {keeps|holds} your {place|book open|notes}.
{Access|Entry} to the {roof|attic|inner pocket|battery case} is {easy|free|from the side} {with the ladder|by a zip|once the lid is off}.
{The script|This script} of the {play|film} {has three acts|fits in one volume|was never filmed}.
The {session|course|class} {lasts|takes} {an hour|40 minutes|two days} {and needs no gear|in all|with a break}.
{Not found|Hard to find} in {shops|most stores}, this {tea|wood|fabric} {comes from small farms|is made by hand|is rare}.
{Nothing|Little} {went wrong|gets lost|can break} when we {tested it|dropped it|packed it} {ten times|on stone|for the trip}.
{Required|Needed} are {two screws|four batteries|a flat base} {that are not included|and some glue|of the same kind}.
{Description and drawings|A full description|Notes and pictures} {are in the leaflet|help you along|come with the kit}.
{No|There is no} {assembly|glue|tool|drilling} {needed|is needed|required} {at all|for the shelf|to hang it}.
{Please note|Note} that {colours may differ|each piece is unique|wood is a natural material} {a little|from the photo|and may vary}.
{The|Its} {content|volume|capacity} {is enough for|lasts for|covers} {two rooms|a week|ten cups}.
{Coming|Sold} {in a solid box|in pairs|with a cloth bag}, it {makes a good gift|is ready to use|stays clean}.
{Turn|Switch} {it|the lamp|the heater} {on|off} {and off|with a tap|by the cord} {in the dark|from your bed|without a sound}.
{Enable|Allow} {yourself|your guests} {a quiet evening|a short rest|some fresh air}.
{The timer|A timer|The alarm} {runs for|waits|counts down} {60 seconds|five minutes|an hour} and then {stops|rings|beeps twice}.
{Do not|Never} {wash it hot|leave it in the sun|use bleach|bend the blade}.
{You can|You may} {wash|clean|open|fold|use} {it|them} {by hand|every day|with one hand|indoors and outdoors}.
{Children|Guests|Owners|Cooks|Drivers} {like|love|praise} {the soft handle|how light it is|its calm colour|the simple form}.
{It|This} {fits|suits|holds} {most cups|any table|up to 20 kg|a small kitchen}, {even when wet|and looks neat|as tests have shown}.
The {handle|lid|base|cover|strap|blade|shade} is {made of|cut from|lined with} {steel|oak|cotton|glass|cork|recycled plastic}.
{Made|Sewn|Built|Printed} in {Portugal|a small workshop|our own factory} {since 1990|from local wood|with great care}.
{Does it|Will it} {fit|work|last} {in a small car|with older models|for years}?
{The blade|The kettle|The knife} is made of {304|440|18/10} steel and {stays sharp|does not rust|keeps its edge}.
{Item|Part|Model} {no.|number} {404|500|503} {comes in blue|has been improved|is 30 cm long}.
{At|From} {7.30|8} {in the morning|on} the {coffee|bread|tea} is {ready|warm}, {every day|thanks to the timer}.
{Der Becher|Das Schild|Das Plakat} {trägt|zeigt} {den Spruch|die Worte} {Seite nicht gefunden|Zugriff verweigert|kommt bald} in {großen|weißen} Buchstaben.
{Das Buch|Der Kurs} erklärt, {wie Skripte im Browser laufen|warum Server ausfallen|wie man eine gute Beschreibung schreibt}.
{Legen Sie die Batterien ein|Fügen Sie heißes Wasser hinzu} und {schließen Sie den Deckel|warten Sie fünf Minuten}.
{Bitte beachten Sie|Beachten Sie bitte}, dass {die Farbe leicht abweichen kann|Holz arbeitet}.
{Le livre|Ce guide} explique {comment un navigateur charge une page|pourquoi un serveur tombe en panne|comment activer un minuteur}.
{La tasse|L'affiche} porte les mots {page introuvable|accès refusé|à venir} en {grandes lettres|lettres blanches}.
{Insérez les piles|Ajoutez de l'eau chaude} et {fermez le couvercle|attendez cinq minutes}.
{El libro|La guía} explica {cómo un navegador carga las páginas|por qué falla un servidor|cómo escribir una buena descripción}.
{La taza|El cartel} lleva las palabras {página no encontrada|acceso denegado|próximamente} en letras {grandes|blancas}.
{Inserte las pilas|Añada agua caliente} y {cierre la tapa|espere cinco minutos}.
{Il libro|La guida} spiega {come un browser carica le pagine|perché un server si ferma}.
{La tazza|Il cartello} porta le parole {pagina non trovata|accesso negato|in arrivo} in {grandi lettere|lettere bianche}.
{Inserire le batterie|Aggiungere acqua calda} e {chiudere il coperchio|attendere cinque minuti}.
{O livro|O guia} explica {como um navegador carrega páginas|por que um servidor falha}.
{A caneca|O cartaz} traz as palavras {página não encontrada|acesso negado|em breve} em letras {grandes|brancas}.
{Insira as pilhas|Adicione água quente} e {feche a tampa|espere cinco minutos}.
{Книга|Эта книга} рассказывает, {как браузер загружает страницы|почему серверы отказывают|как включить таймер}.
{На кружке|На плакате} написано {страница не найдена|доступ запрещён|скоро} {большими|белыми} буквами.
{Вставьте батарейки|Добавьте горячую воду} и {закройте крышку|подождите пять минут}.
{この本は|このガイドは}{ブラウザがページを読み込む仕組みを|サーバーが止まる理由を|良い説明の書き方を}{説明します|教えてくれます}。
{マグカップには|ポスターには}{ページが見つかりません|アクセスが拒否されました|近日公開}と{大きな文字で|白い文字で}書かれています。
{電池を入れて|お湯を入れて}{ふたを閉めます|五分待ちます}。
{Der Griff|Die Lampe|Das Gehäuse|Der Deckel} {besteht aus|ist aus} {Holz|Stahl|Glas} und {lässt sich leicht reinigen|hält viele Jahre|liegt gut in der Hand}.
{Die Lampe|Das Licht|Die Anzeige} {blinkt|leuchtet rot}, wenn {die Batterie leer ist|der Filter voll ist|ein Fehler auftritt}.
{Passt|Hält} {es|das} auch in {kleine Räume|ältere Geräte}?
{Das Heft|Der Block} hat {zwanzig leere Seiten|ein Feld für den Namen} zum {Ausfüllen|Beschreiben}.
{Le couvercle|La poignée|La lampe} est {en bois|en acier|en verre} et {se nettoie facilement|dure des années|tient bien en main}.
{La lampe|Le voyant} {clignote|devient rouge} quand {la pile est vide|le filtre est plein|une erreur survient}.
{Le carnet|La fiche} a {vingt lignes vides|un champ pour le nom} à remplir {à la main|soi-même}.
{La tapa|El mango|La lámpara} es de {madera|acero|vidrio} y {se limpia fácilmente|dura muchos años|cabe en la mano}.
{La luz|El piloto} {parpadea|se pone rojo} cuando {falta batería|el filtro está lleno|hay un error}.
{El cuaderno|La ficha} tiene {veinte líneas vacías|un campo para el nombre} para rellenar {a mano|en casa}.
{Il coperchio|Il manico|La lampada} è {in legno|in acciaio|in vetro} e {si pulisce facilmente|dura molti anni}.
{La luce|La spia} {lampeggia|diventa rossa} quando {la batteria è scarica|il filtro è pieno|c'è un errore}.
{A tampa|A alça|A lâmpada} é {de madeira|de aço|de vidro} e {limpa-se facilmente|dura muitos anos}.
{A luz|O indicador} {pisca|fica vermelho} quando {a bateria acaba|o filtro está cheio|há um erro}.
{Крышка|Ручка|Лампа} {сделана из дерева|сделана из стали|из стекла} и {легко моется|служит много лет}.
{Лампа|Индикатор} {мигает|горит красным}, если {батарея разряжена|фильтр заполнен|есть ошибка}.
{В тетради|В блокноте} {двадцать пустых страниц|есть поле для имени}, чтобы {заполнить от руки|писать заметки}.
{ふたは|取っ手は|ランプは}{木製で|鋼製で|ガラス製で}{長持ちします|洗いやすいです|軽いです}。
{ランプが|表示が}{赤く光ったら|点滅したら}{電池を替えてください|フィルターを洗います}。
{ノートには|カードには}{名前を書く欄が|空白の行が}{あります|ついています}。
"""
#: The words of the customary filler text.
LATIN_FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()


def expand(pattern: str, most: int, rng: np.random.Generator) -> list[str]:
    """At most ``most`` readings of a pattern, drawn at random where there are more."""
    parts = [p[1:-1].split("|") if p.startswith("{") else [p] for p in re.split(r"(\{[^{}]*\})", pattern) if p]
    total = int(np.prod([len(p) for p in parts]))
    if total <= most:
        picks = itertools.product(*parts)
    else:
        picks = (tuple(p[rng.integers(len(p))] for p in parts) for _ in range(most))
    return list(dict.fromkeys(re.sub(r"\s+", " ", "".join(x)).strip() for x in picks))


def families(text: str) -> list[str]:
    return [line for line in text.strip().split("\n") if line]


def filler(n: int, rng: np.random.Generator) -> list[str]:
    """Customary filler: its beginning, and its words in any order."""
    out = ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Lorem ipsum dolor sit amet"]
    for _ in range(n):
        words = rng.choice(LATIN_FILLER, rng.integers(4, 14)).tolist()
        out.append(" ".join(words).capitalize() + ".")
    return out


def residue_texts(most: int = 120, without: frozenset[str] = frozenset()) -> list[str]:
    """Readings of all residue patterns but those of the families ``without``, and filler."""
    rng = np.random.default_rng(7)
    out = [t for p in families(STAND_IN) + families(ERRORS) + families(SCRIPTS) if p not in without for t in expand(p, most, rng)]
    return out + filler(200, rng)


def ordinary_texts(most: int = 120, without: frozenset[str] = frozenset()) -> list[str]:
    rng = np.random.default_rng(8)
    return [t for p in families(ORDINARY) if p not in without for t in expand(p, most, rng)]
