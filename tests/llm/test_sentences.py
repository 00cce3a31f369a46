"""Sentences by rule tables: hand-made cases of each language, places in the text, and defined results."""

import pandas as pd
import pytest

from quillstream.llm.sentences import cascade, language_of, sentence_ends, sentence_spans, sentences

#: Sentences of a text, joined by what stands in the second place.
CASES = [
    ("en", " ", ["Dr. Ames met Mrs. Bohr at 6 p.m. on Jan. 4.", "See Fig. 3 (cf. p. 12) and vol. 2, no. 7.", "It rose by 3.5 percent, i.e. a bit.", "Fine!"]),
    ("en", "", ["We saw the old harbour.", "Then the tide came!", "Was it late?", "It was."]),
    ("en", " ", ["“It works. It scales,” said Ada.", "He wrote: “Not one. None.”", "“Is it done?” asked Bo.", "“Is it done?” Bo asked.", "J. R. Oak left."]),
    ("en", "\n\n", ["A heading without a mark", "1. First point.", "- Second point\nwrapped here", "mail a.b@c.example now ... and go."]),
    ("de", " ", ["Am 8. März fehlten z. B. 3,5 Mio. Taler.", "„Geht es?“, fragte Uwe.", "Der 2. Lauf u. der 9. Versuch endeten, d. h. alles.", "Siehe Abb. 13.", "Ende."]),
    ("fr", " ", ["M. Roy cite la p. 3 et le vol. 8.", "« Est-ce prêt ? » demanda Luc.", "J.-P. Roy vient à 6 h. 25, p. ex. ici.", "Quoi\xa0!", "Le reste, etc."]),
    ("es", " ", ["La Dra. Paz cita la pág. 2 de EE. UU. hoy.", "—¿Listo? —preguntó Ana.", "¡Sí!", "¿Por qué?", "Bien."]),
    ("ru", " ", ["В 2010 г. нашли т. е. около 3,5 тыс. монет.", "«Готов?» — спросил Олег.", "Письма и т. д.", "Архив закрыт."]),
    ("ar", " ", ["قال د. سالم إن الكلفة 3.5 ضعفا.", "«هل انتهى؟» سأل سالم.", "نعم."]),
    ("hi", " ", ["डॉ. राम के अनुसार 3.5 गुना रही।", "“क्या हुआ?” राम ने पूछा।", "ठीक है!"]),
    ("ja", "", ["「もう終わったのか？」と彼は言った。", "「動く。速い。」という言葉が残った。", "版2.5では出た（図3を参照）。", "なぜ？", "本当！"]),
    ("zh", "", ["“能用。很快。”温可舟这样评价。", "他停了一下……然后走了。", "约为3.5倍。", "为什么？"]),
    ("th", " ", ["คณะกรรมการใช้เวลา 26.5 ชั่วโมง", "รายงานของ Polul ระบุว่าระบบเปิดแล้ว", "เมื่อ พ.ศ. 2547 ดัชนีใหม่เปิด", "บรรณารักษ์ปิดประตู"]),
]


@pytest.mark.parametrize("lang, joint, wanted", CASES)
def test_sentences_of_each_language(lang, joint, wanted):
    text = joint.join(wanted)
    for named in (lang, lang.upper(), f"{lang}-XA", None if lang not in ("th", "fr", "de", "es") else lang):
        assert [text[a:b] for a, b in sentence_spans(text, named)] == wanted


def test_wrong_language_is_overruled_by_the_script():
    assert language_of("本当に終わったのか？はい。", "en") == "ja"
    assert language_of("The cat and the dog of the house", "ja") == "en"
    assert language_of("x" * 5_000 + " Почему не хватает карт?", "ru") == "ru"


def test_first_matching_rule_decides():
    assert all(len(rule) == 3 for lang in ("en", "ja", "th", "xx") for rule in cascade(lang))
    assert [b for _, b in sentence_spans("No. Never. See no. 3.", "en")] == [3, 10, 21]


def test_empty_long_and_repeated_rows(spark):
    long_run = "y" * 200_000
    frame = pd.DataFrame(
        {
            "doc_id": [1, 2, 3, 4, 5, 5],
            "text": [None, "", " \n\n ", long_run + "." * 1_000 + "(" * 1_000, "One. Two.", "One. Two."],
            "lang": ["en", None, "en", None, "en", "en"],
            "sent_end": [0] * 6,
        }
    )
    docs = spark.createDataFrame(frame, "doc_id bigint, text string, lang string, sent_end int")
    rows = sorted((r.doc_id, r.sent_end) for r in sentence_ends(docs).collect())
    assert rows == [(4, 202_000), (5, 4), (5, 4), (5, 9), (5, 9)]
    assert sentence_ends(docs.limit(0)).count() == 0
    units = sentences(docs.where("doc_id = 5")).collect()
    assert {(u.sent_no, u.sentence) for u in units} == {(0, "One."), (1, "Two.")}


def test_ends_count_code_points():
    text = "🚀 Up. 🧪🧪 Down."
    assert [b for _, b in sentence_spans(text, "en")] == [5, len(text)]
