"""Texts that the models of residue were not fitted on: other wordings of residue, and ordinary sentences like it."""

RESIDUE = """We could not locate the page that you wanted.
This listing has gone missing from our server.
HTTP 418
HTTP 410 Gone
KeyError: 'price'
ZeroDivisionError: division by zero
java.lang.ClassNotFoundException: shop.Item
Unexpected token < in JSON at position 0
Error establishing a database connection
Sorry, we are having technical problems.
The page is temporarily out of service.
Please wait while the page loads.
This request has been blocked.
Your connection was interrupted, please reload.
Description will be supplied by the vendor.
Text to be supplied by marketing.
[no description]
Add short product text here.
Please supply a description for this item.
Copy goes here, about 50 words.
Some dummy words for the layout.
do not use, test only
test test 123
asdfasdf
qwe asd zxc
Ipsum dolor amet, tempor magna aliqua veniam.
JavaScript must be enabled to show this listing.
You have scripting turned off.
For full functionality of this site it is necessary to enable JavaScript.
Scripts must be allowed for this page to load.
We noticed that cookies are blocked in your browser.
Your browser is out of date.
Leider ist ein Fehler aufgetreten.
Die gewünschte Seite existiert leider nicht.
Text wird nachgereicht.
Um diese Seite zu nutzen, muss JavaScript aktiviert sein.
Cette page n'existe plus.
Le texte sera ajouté prochainement.
JavaScript doit être activé pour voir cette page.
Se produjo un error al cargar la página.
La descripción se añadirá más tarde.
Para ver esta página debe activar JavaScript.
La pagina che cerchi non esiste più.
La descrizione sarà aggiunta presto.
Per vedere questa pagina serve JavaScript.
Esta página não existe mais.
A descrição será adicionada em breve.
Страница удалена или не существует.
Описание товара появится позднее.
Для отображения страницы требуется включить JavaScript.
このページは存在しません。
商品説明は後日公開します。
このページの表示にはJavaScriptが必要です。""".split("\n")

ORDINARY = """The cable comes with a spare plug and a cloth bag.
Heat the water first and add two spoons of tea.
Insert the filter and press the lid down.
Error-free printing thanks to dry ink.
Replace the filter every two months.
Wait ten minutes before you open the lid.
Add some salt and stir the soup.
A sticker with the words coming soon for your shop window.
This tea towel says lorem ipsum in blue letters.
A novel about a programmer who finds an error in an old machine.
The cup bears the line 404 coffee not found.
Your logo goes here on the side of the pen, in one colour.
Ten blank pages at the end leave room for your own notes.
A placeholder made of brass holds the name card of each guest.
The test kit shows within minutes if the water is safe.
This handbook explains how to turn scripts on and off in common browsers.
The server trolley carries up to 40 kg.
Please enable the child lock before you leave the room.
The description of each knot is printed on the card.
A dummy for tailors, with a stand of solid beech.
The sample pack has three kinds of coffee.
Write your name on the back with a soft pencil.
Type the number on the keypad and the box opens.
Sorry, no matches: this lighter works with gas.
The request bell rings in the kitchen.
Access to the battery is from below.
No page of this diary is lost when the binding is open.
Not available in stores, this honey comes from one village.
The item is 30 cm long and weighs 400 g.
Session beer with little alcohol and a light taste.
The lamp blinks if the connection is loose.
The null line on the scale is marked in red.
The page holder keeps a cook book open.
Browser is the name of our widest hat.
Das Handbuch beschreibt, wie man Skripte im Browser aktiviert.
Auf dem Schild steht: Bitte später wiederkommen.
Der Fehler im Glas gehört zum alten Verfahren.
Ce carnet a vingt pages à compléter par l'enfant.
Une affiche avec les mots page introuvable en rouge.
El manual explica cómo activar los scripts del navegador.
Una lámpara de prueba con luz de error.
Il cartello con la scritta torno subito è di legno.
O livro mostra como os servidores falham.
Плакат с надписью ошибка 404 для кабинета.
Эта лампа мигает, если батарея разряжена.
エラーランプが赤く光るテスターです。
このノートには空白のページが十枚あります。
Save 10 % when you order {two|three}-part sets.
It fits boxes [S] to [XL].
The <b>red</b> one is sold out.
Use code A_B at $5.""".split("\n")
