"""Texts of other subjects than the tables', with | at each boundary, that nothing was fitted on."""

TEXTS = {
    "en": [
        "The river froze early that year.|Nobody crossed it on foot, though; the ice was thin.|Prof. Allen measured 3.7 cm on Jan. 9 and 4.1 cm a week later.|Was it safe?|No!",
        "“I have never seen the sea,” the boy admitted.|His aunt laughed.|She had lived in St. Ives, approx. 2 miles from the coast, since 1987.|They left the next day.",
        "Version 2.0 of the report came out at 10 a.m. on Monday.|It lists errors in chap. 4, vol. 2.|Mr. and Mrs. Hale signed it... but only reluctantly.|See www.example.org for details.",
        "He asked, \"Who is there?\" and waited.|(Nobody answered.)|The U.N. office in the U.S. closed in 2004.|Its staff, i.e. 40 people, moved to Geneva.",
    ],
    "de": [
        "Der Zug hält um 7.45 Uhr in Bonn.|Am 12. September beginnt das Semester.|Frau Dr. Klein, d. h. die neue Leiterin, kommt aus Köln.|Wirklich?|Ja, wirklich!",
        "„Ich gehe jetzt“, sagte er leise.|Niemand antwortete.|Ludwig XIV. regierte lange.|Die Kosten stiegen auf ca. 3,5 Mio. Euro.",
    ],
    "fr": [
        "Le train part à 8 h 15.|M. Leroy habite au 3e étage, p. ex. avec sa sœur.|« Où vas-tu ? » demanda-t-elle.|Il ne répondit pas.|Quelle histoire !",
        "Elle a lu le chap. 5 en env. deux heures.|Puis elle a dormi.|C'était en 1998.",
    ],
    "es": ["La Sra. Ortega llegó a las 9.30.|¿Quién la esperaba?|Nadie.|«No importa», pensó.|Vive en la av. Colón desde 2011, aprox. a dos km del centro.|¡Qué calor!"],
    "it": ["Il sig. Bianchi abita a Torino.|Ha letto pag. 12 e pag. 13.|«Che bello!» esclamò Anna.|Poi uscirono.|Perché piove?"],
    "pt": ["O Dr. Costa chegou às 10.45.|Ninguém sabia disso.|“Vamos embora”, disse o menino.|A reunião acabou em 2015.|E agora?"],
    "ru": ["Поезд пришёл в 7.40.|А. С. Пушкин родился в 1799 г. в Москве.|«Ты куда?» — спросила она.|Он молчал.|Цена выросла до 5 тыс. руб. за год.|Почему?"],
    "ja": ["山の上に古い寺があります。|「誰もいない。静かだ。」と彼は言った。|本当に静かでした！|気温は3.5度まで下がった。|明日は晴れるでしょうか？"],
    "zh": ["河水很早就结冰了。|“你去哪儿？我也去。”他问。|她没有回答……只是笑了笑。|气温降到了3.5度。|真冷！"],
    "hi": ["नदी जल्दी जम गई।|क्या वह सुरक्षित थी?|नहीं!|तापमान 3.5 डिग्री तक गिर गया।|लोग घर लौट आए।"],
    "ar": ["تجمد النهر مبكرا هذا العام.|هل كان آمنا؟|لا!|انخفضت الحرارة إلى 3.5 درجة.|عاد الناس إلى بيوتهم."],
    "th": ["แม่น้ำแข็งตัวเร็ว|ไม่มีใครข้ามไป|อากาศหนาวมาก"],
}


def glue(lang: str) -> str:
    return "" if lang in ("ja", "zh") else " "
