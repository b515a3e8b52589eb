"""Labelled sentences from which the weights of the sentence model are fitted; none stems from a test table.

A sample is a list of whole sentences of one language. {n} is a number, {p} a surname, {a} an abbreviation
that never ends a sentence, {m} one that may. Paragraphs are put together from sentences of one list.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

# Labelled sample: sentences by language.
SENTENCES: dict[str, list[str]] = {
    "en": ["The harbour crane lifted {n} containers.", "Dr. {p} and Prof. {p} compared Fig. {n} with Tab. {n} of the annex.", "Sales reached {n}.5 million in 1997.",
           "{p} et al. measured approx. {n} volts, i.e. twice the limit.", "The firm {p} Inc. delivered it to {p} Ltd. on time.", "They sell ropes, nets, hooks, etc.",
           "It left at 5 p.m. and returned at 9 a.m. next day.", "The U.S. Army bought {n} of them.", "He moved to the U.S.", "J. R. {p} wrote the manual.", "Was the valve open?",
           "“Shut it down! The pump is dry. Nobody noticed,” {p} shouted.", "The clerk asked, “Who signed? And when?”", "The note says: \"Valve closed. Gauge at {n}. No leak.\"",
           "The hull (built in {n}. rebuilt twice. sold later) was scrapped.", "See Vol. {n}, pp. {n} ff. for details.", "Well … nobody knew.", "It failed... and then it worked.",
           "n-type silicon was used.", "eMAIL-based alerts came first.", "What a day!", "No. {n} was lost.", "The beam weighs {n} kg.", "Mr. {p} left.", "The distance is {n} km. That was new to us.",
           "St. {p} Street lies behind the depot.", "The rev. {n} sheet replaces rev. {n} entirely.", "Its mass (max. {n} kg) is stated in Sec. {n}.", "3 engines were tested.", "(The second one was lost.)",
           "“Never again,” she said.", "Was it {p} vs. {p}?", "It took {n} min. without a break.", "Yes.", "The probe hit –{n} degrees.", "The lid said ‘Keep dry. Store flat.’ in red.",
           "The yard of {p} S.A. in Porto built {n} tugs.", "It passed from {p} S.A. to {p} Corp. in 1988.", "Sgt. R. {p} and Lt. Col. {p} met at Mt. {p}.", "They camped near St. {p} and Mt. {p} for {n} days.", "The U.S. Navy and the U.K. Government paid.",
           "It was made for use in the U.S. by {p} & Co. of Leeds.", "The motor draws {n} kW.", "The rope is {n} m long and weighs {n} kg.", "{n} hooks were bent.", "The figure, e.g. that of {p} S.A., is low.", "It left the U.K. in 1990.", "Members meet at {n} p.m.", "The oar measures {n} cm.",
           "The older ferry was last seen near Mt. {p} in the autumn of 1988 and carried {n} guests from there to the island without a stop.",
           "Lt. {p}, who had kept the books at St. {p} for more than twenty years, never wrote a word about the {n} missing crates.",
           "According to {p} Ltd., the ropes that were sold to the town in 1975 had been stored in the open for {n} weeks.",
           "Tugs of that size, e.g. those of {p} Inc., need {n} men, but the crews of Gen. {p} and Capt. {p} made do with half of that.",
           "The contract went to {p} Ltd. and later to {p} Bros. of Hull.", "The order went to {p} Corp.", "What a fine result!", "Go.", "Up.", "All gone.", "He ran.", "They paid.", "It sank.", "Nobody came.", "Why not?", "We ate.",
           "The men who rowed it every morning for {n} years said that the old oars had a length of {n} cm.", "One list has {n} kg, the other {n} mm.", "The new motor, unlike the one it replaced, takes {n} kW.",
           "A careful reader will note that the drawings were copied by hand from an older set that nobody has seen since the fire in the autumn of that year.",
           "In most of the ports along that coast the keepers kept two books, one for the harbour board and another for the insurers, and hid both of them.",
           "Reports of the loss reached the town only after the second ferry had been taken out of service and sold to a broker abroad."],
    "de": ["Am 3. Mai 1998 wurde die Brücke eröffnet.", "Das ist der 2. Versuch, und der 14. Motor läuft.", "Hr. Dr. {p} u. a. prüften bzw. maßen {n} Proben.", "Das Modell wiegt ca. {n} kg.",
           "Dazu zählen Seile, Haken usw.", "Die Pumpe ist z. B. dicht, d. h. sie hält.", "„Halt! Das Ventil ist offen. Niemand sah es“, rief {p}.", "Wer hat das gebaut?", "Siehe Abb. {n} und Nr. {n}.",
           "Die Fa. {p} lieferte {n} Stück im Jahr 1994.", "Der Preis stieg auf {n} Mio. Euro.", "Es endete um {n} Uhr.", "Sie maßen lt. Plan {n} mm. Danach ruhte alles.", "Der Träger (alt. {n} m lang. selten genutzt) brach.",
           "Der Motor braucht {n} kW.", "Das Seil ist {n} mm dick und wiegt {n} kg.", "{n} Haken waren krumm.", "Die {p} AG und die {p} e. V. zahlten.", "Der Kran hielt!", "Er kam.", "Alles gut.", "Wir gingen.",
           "Nach Angaben von Prof. {p}, der den Versuch in der Nähe von St. {p} über mehrere Wochen begleitet hat, fehlten am Ende nur {n} Haken."],
    "fr": ["M. {p} et Mme {p} ont signé.", "La pompe pèse {n},5 kg.", "« Arrêtez ! La vanne est ouverte. Personne ne sait », dit {p}.", "Pourquoi ce retard ?", "Quel bruit !", "Voir p. {n}, fig. {n} et chap. {n}.",
           "On y trouve câbles, crochets, etc.", "Il fut livré en 1994.", "Le no. {n} manque.", "C’est, p. ex. {p}, un essai.", "Le mât a tenu.", "Le moteur demande {n} kW.", "{n} crochets manquent.", "La société {p} S.A. de Lyon paie."],
    "es": ["El Sr. {p} y la Dra. {p} firmaron.", "¿Quién lo firmó? ", "¡Qué ruido!", "La bomba pesa aprox. {n} kg.", "El buque fue a EE. UU. en 1990.", "Véase pág. {n} y núm. {n}.", "Hay cables, ganchos, etc.",
           "«¡Alto! La válvula está abierta. Nadie lo vio», gritó {p}.", "Se usó en 1994.", "¿Falló la n. {n} o la núm. {n} otra vez?", "El art. {n} lo prohíbe.", "El motor gasta {n} kW.", "La firma {p} S.A. pagó todo.", "{n} ganchos faltan."],
    "ru": ["В 1990 г. завод закрыли.", "Он весит {n} кг.", "Насос, кабель и т. д.", "«Стой! Клапан открыт. Никто не видел», — крикнул {r}.", "Кто подписал?", "См. рис. {n} и стр. {n}.", "А. П. {r} написал отчёт.",
           "Цена {n} млн. рублей.", "Он ушёл в 5 ч. утра.", "Какой шум!", "Длина равна {n}.5 км.", "Это было в 1994 г.", "Мост, т. е. его опора, цел.", "Мотор берёт {n} кВт.", "Трос весит {n} кг. и длинен.", "{n} крюков пропали."],
    "ar": ["وصل القطار في الساعة {n}.", "قال: «توقف. الصمام مفتوح. لم يره أحد».", "من وقع العقد؟", "يا له من ضجيج!", "وزن المضخة {n}.5 كغ.", "استلم د. سامر {n} قطعة.", "انتهى العمل في 1994.", "وزن الحبل {n} كغ.", "طول الجسر {n} كم."],
    "hi": ["पंप का भार {n} कि. ग्रा. है।", "डॉ. रमेश ने लिखा।", "उसने कहा, “रुको। वाल्व खुला है। किसी ने नहीं देखा।”", "किसने लिखा?", "काम 1994 में पूरा हुआ।", "कितना शोर!"],
    "th": ["ปั๊มหนัก {n}.5 กิโลกรัม", "งานเสร็จในปี 1994", "ไม่มีใครเห็น", "ใช้เวลา {n} ชั่วโมง", "วาล์วเปิดอยู่ตลอดเวลา", "เครื่องรุ่น AB {n} ทำงานได้ดี", "กำลังไฟ {n} วัตต์ต่อหน่วย", "ราคา {n} บาท"],
    "zh": ["水泵重{n}.5公斤。", "他喊道：“停下！阀门开着。没人看见。”", "谁签的字？", "噪声真大！", "一切……都很安静。", "工程于1994年完成。"],
    "ja": ["ポンプの重さは{n}kgである。", "報告には「停止。弁は開いていた。」とある。", "誰が署名したのか？", "工事は1994年に終わった。", "「弁が開いている。」という声がした。", "静かだ！"],
}
_NAMES = {"p": ["Larkin", "Osgood", "Weber", "Durand", "Moreno", "Zielke"], "r": ["Орлов", "Гусев"]}


def paragraphs(count: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """(text, starts of its sentences): paragraphs of one to eight sentences with the usual defects.

    A few sentences lose the blank between them, quotations and brackets that never close occur, and
    lines may be wrapped.
    """
    rng = random.Random(seed)
    langs = sorted(SENTENCES)

    def fill(m: re.Match) -> str:
        key = m.group(1)
        return str(rng.choice([rng.randint(2, 40), rng.randint(100, 2000)])) if key == "n" else rng.choice(_NAMES[key])

    for k in range(count):
        lang = "en" if k % 3 == 0 else rng.choice(langs)
        text, starts = "", []
        for i in range(rng.randint(1, 8)):
            s = re.sub(r"\{(\w)\}", fill, rng.choice(SENTENCES[lang])).strip()
            if lang not in ("th", "zh", "ja") and rng.random() < 0.04:
                words = s.split(" ")
                words[rng.randrange(len(words))] = rng.choice("(“„«") + words[0]
                s = " ".join(words)
            if text:
                glue = "" if lang in ("zh", "ja") else " "
                if lang in ("en", "fr", "es", "de") and rng.random() < 0.08 and re.search(r"[a-zé]\.$", text) and s[0].isupper():
                    glue = ""
                elif rng.random() < 0.1 and glue:
                    glue = rng.choice(["\n", "  "])
                text += glue
            starts.append(len(text))
            text += s
        yield text, starts
