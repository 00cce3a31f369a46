"""Sentence boundaries by cascading tables of break and no-break rules (problem 8).

A rule is a pair of regular expressions, one for what stands before a position and one for what
follows it. The rules of a language are tried first, then those of its script, then the common
ones; the first that matches decides the position. Positions are tried after a run of end marks with
the closing quotes and brackets behind it (in Thai, before white space too). A blank line always
ends a sentence, inside a pair of quotes nothing else does.

Defined results: positions count code points; a null, empty or blank text has no sentence; a text
without any mark is one sentence per block between blank lines; repeated rows give repeated results;
null and unknown ``lang`` are decided by the letters and the commonest words of the text, as are
texts whose script the named language doesn't use.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAK, KEEP = True, False
MARKS = ".!?…。！？।॥؟۔"
CLOSERS = "\"'”’»›」』】）)\\]"

#: Words whose full stop ends no sentence, and those whose full stop may end one before a capital (fixed values).
NEVER_LAST = {
    "en": "Mr Mrs Ms Messrs Dr Prof Sgt St Gen Rep Sen Gov Pres Rev Hon Capt Cmdr Lt Col Maj Fig Figs Eq Eqs Sec Ch Nos cf vs viz approx est ca "
    "e.g i.e al Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec Mt Ft Art Ref Refs ed eds",
    "de": "Dr Prof Hr Hrn Fr Nr Abb Abs Art Bd Bde Kap Tab S s Mio Mrd Tsd ca bzw vgl z.B z u d i o a evtl ggf inkl exkl max min St Str Jh geb gest Ing Dipl sog Jan Feb Apr Aug Sept Okt Nov Dez",
    "fr": "M MM Dr Pr Me Mgr St Ste av bd n° pp fig chap art éd env cf tél janv févr avr juil sept oct nov déc J.-P",
    "es": "Sr Sra Sres Srta Dr Dra Prof Ing Lic D Dña Ud Uds EE pág págs núm núms fig figs cap caps art vol aprox S Sto Sta Avda av tel ed",
    "ru": "стр рис табл гл ст см ср т п Проф проф акад им ул пр кв тыс млн млрд руб коп св напр т.е т.к",
    "ar": "د أ م ص ج هـ ت ط",
    "hi": "डॉ पृ श्री श्रीमती सं क्र प्रो रु ई",
}
#: Those that end no sentence before a number (fixed values).
BEFORE_NUMBER = {"en": "p pp vol Vol no No", "fr": "p no vol h", "es": "p", "ru": "г"}
SAID = "said|asked|wrote|replied|answered|added|cried|noted|says|asks|told|warned|explained"
#: The commonest words that tell the Latin-script languages apart (fixed values).
COMMON_WORDS = {
    "en": "the of and to in is was that for with by on at from it every our",
    "de": "der die das und ist den dem ein eine zu nicht mit im am wie auf von des",
    "fr": "le la les des et est un une du dans que pour au sur par il ne pas",
    "es": "el la los las y es un una del que en por con para según se no su",
}
#: First words of the Unicode names of the letters of each script (fixed values).
_SCRIPTS = {"THAI": "th", "HIRAGANA": "ja", "KATAKANA": "ja", "CJK": "zh", "DEVANAGARI": "hi", "ARABIC": "ar", "CYRILLIC": "ru", "LATIN": ""}


def _abbreviations(language: str) -> list[tuple[bool, str, str]]:
    rules = []
    for table, after in ((NEVER_LAST, r"\s*\S"), (BEFORE_NUMBER, r"\s+\d")):
        if words := table.get(language, "").split():
            either = "|".join(regex.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
            rules.append((KEEP, rf"(?<![\p{{L}}\p{{M}}\d])(?:{either})\.", after))
    return rules


_INITIAL = (KEEP, r"(?<![\p{L}\d.])\p{Lu}\.", r"(?:-\p{Lu}|\s+\p{Lu})")
_ORDINAL = r"(?<!\p{L})(?:[Dd](?:er|em|en|es|ie|as)|[AaIi]m|[Vv]om|[Zz]u[mr]|[Bb]is|[Aa]b|[Uu]nd|u\.|[Ss]eit)\s+\d{1,3}\."

#: Rules of each language: (break, before, after).
LANGUAGES: dict[str, list[tuple[bool, str, str]]] = {
    "en": [*_abbreviations("en"), _INITIAL, (KEEP, r"[.!?…]”", rf"\s+\p{{Lu}}[\p{{L}}\p{{M}}'’-]*\s+(?:{SAID})\b")],
    "de": [*_abbreviations("de"), (KEEP, r"\b(?:z\.\s*B|d\.\s*h|i\.\s*d\.\s*R|u\.\s*a|o\.\s*ä)\.", r"\s+\S"), _INITIAL, (KEEP, _ORDINAL, r"\s+\p{L}")],
    "fr": [*_abbreviations("fr"), (KEEP, r"\bp\.\s*ex\.", r"\s+\S"), _INITIAL],
    "es": [*_abbreviations("es"), (KEEP, r"\bp\.\s*ej\.", r"\s+\S"), _INITIAL, (KEEP, r"[.!?…]", r"\s+—\s*\p{Ll}")],
    "ru": [*_abbreviations("ru"), _INITIAL],
    "ar": [*_abbreviations("ar"), (KEEP, r"(?:^|[.!?؟]\s+|\n\s*|\d\.\s+|[-•*]\s+)«[^«»]*[.!?؟]»", r"\s+\p{L}")],
    "hi": [*_abbreviations("hi"), (KEEP, r"(?:^|[.!?।]\s+|\n\s*|\d\.\s+|[-•*]\s+)“[^“”]*[.!?।]”", r"\s+\p{L}")],
    "ja": [(KEEP, r"[。！？…]+[」』]", r"(?:[とはがをにのもでや、]|という)"), (KEEP, r"…", r"[^\s」』]")],
    "zh": [(KEEP, r"(?:^|[。！？]\s*|\n\s*|\d\.\s+|[-•*]\s+)“[^“”]*[。！？…]”", r"[\p{Han}]"), (KEEP, r"…", r"[^\s”』]")],
    "th": [
        (KEEP, r"[\d\p{Nd}]", r"\s"),
        (KEEP, r"", r"\s+\p{Nd}"),
        (KEEP, r"[\p{Latin}]", r"\s"),
        (KEEP, r"", r"\s+\p{Latin}"),
        (KEEP, r"\p{Thai}\.", r"\s"),
        (KEEP, r"", r"\s+(?:\p{Thai}{1,4}\.)+(?:\s|$)"),
        (KEEP, r"(?:^|\n)\s*(?:[-•*–]|\d{1,3}[.)])", r"\s"),
        (BREAK, r"[\p{Thai}!?…\"'”’»)\]]", r"\s+[^\s]"),
    ],
}
_SPACED = [
    (KEEP, r"", r"\s*[,;:]"),
    (KEEP, r"", r"\s+[—–]\s*\p{Ll}"),
    (KEEP, rf"[.!?…](?:\s?[»›]|[{CLOSERS}“])*", r"\s+\p{Ll}(?!\p{Lu})"),
    (BREAK, r"(?:\p{Ll}{2}|\d\d)\.", r"[¡¿“«„\p{Lu}]"),
    (BREAK, rf"[!?…।॥؟۔][{CLOSERS}]*", r"[¡¿“«„\p{Lu}\p{Lo}]"),
    (BREAK, rf"\.[{CLOSERS}]+", r"\p{Lu}"),
]
_UNSPACED = [(BREAK, rf"[。！？][{CLOSERS}]*", r"[^、，,;；]"), (BREAK, rf"[!?][{CLOSERS}]*", r"[\p{Han}\p{Hiragana}\p{Katakana}“「]")]
#: No abbreviation is so long a word; a number or bullet belongs to what it introduces; in the end white space decides.
_FIRST = [
    (BREAK, r"\p{Ll}{7}[.!?]", r"\s+\p{Lu}"),
    (KEEP, r"(?:^|\n)\s*(?:\d{1,3}|\p{L}|[ivxIVX]{1,4})[.)]", r"\s+\S"),
]
_LAST = [(BREAK, rf"[{MARKS}][{CLOSERS}“]*(?:\s[»›])?", r"\s+\S")]


def cascade(language: str) -> list[tuple[bool, str, str]]:
    """The ordered rules of ``language``: its own, those of its script, the common ones."""
    script = _UNSPACED + _SPACED if language in ("ja", "zh") else _SPACED + _UNSPACED
    return [*_FIRST, *LANGUAGES.get(language, LANGUAGES["en"]), *script, *_LAST]


@lru_cache(maxsize=None)
def _compiled(language: str) -> tuple[regex.Pattern, list[bool]]:
    """One pattern whose groups are the rules in order, so that the group that matched names the deciding rule."""
    rules = cascade(language)
    return regex.compile("|".join(f"(?:(?<={before})(?={after})())" for _, before, after in rules)), [b for b, _, _ in rules]


_BLANK = re.compile(r"(?:\r\n|[\n\r])[^\S\n\r]*(?:\r\n|[\n\r])\s*")
#: A full stop inside a number, a name or an address is no position at all.
_WITHIN = r"(?!(?<=\.)[0-9a-z])"
_OTHER = rf"[{MARKS}]++(?:\s?[»›]|[{CLOSERS}])*+{_WITHIN}"
_POSITIONS = {
    "": re.compile(_OTHER),
    "de": re.compile(rf"[{MARKS}]++[{CLOSERS}“]*+{_WITHIN}"),
    "th": re.compile(rf"{_OTHER}|(?<=\S)(?=\s++\S)"),
}
_QUOTED = re.compile(r"“[^“”„]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』")
_COMMON = {k: frozenset(v.split()) for k, v in COMMON_WORDS.items()}
_RUN = re.compile(rf"[^\s{MARKS}、，,;:]{{300,}}+")


@lru_cache(maxsize=65_536)
def _script(letter: str) -> str | None:
    return _SCRIPTS.get(unicodedata.name(letter, "").split(" ")[0].split("-")[0]) if letter.isalpha() or unicodedata.combining(letter) else None


def language_of(text: str, lang: str | None) -> str:
    """The language whose rules hold: the named one if the text's script fits it, else by script and common words.

    Long runs without any mark or space (codes, lists of names) say nothing about the language.
    """
    named = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    words = set(text.lower().split())
    hits = {k: len(words & common) for k, common in _COMMON.items()}
    best = max(hits, key=lambda k: (hits[k], k == named, k == "en"))
    if hits[best] == 0 or len(text.encode("utf-8", "replace")) * 4 > len(text) * 5:
        counts = Counter()
        for letter, n in Counter(_RUN.sub("", text) or text).items():
            counts[_script(letter)] += n
        # kana settle Japanese even among many ideographs; Latin names are common in every script
        if counts["ja"] * 20 > counts["zh"]:
            counts["ja"] += counts.pop("zh", 0)
        script = max(("th", "ja", "zh", "hi", "ar", "ru"), key=lambda k: counts[k])
        if counts[script] * 2 > counts[""]:
            return script
    return named if hits.get(named, -1) * 2 >= hits[best] else best


def sentence_spans(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of each sentence of ``text``, without the white space around it."""
    if not text or text.isspace():
        return []
    language = language_of(text, lang)
    (rules, breaks), positions = _compiled(language), _POSITIONS.get(language, _POSITIONS[""])
    out, start = [], 0
    for block_end, next_start in [*(m.span() for m in _BLANK.finditer(text)), (len(text), len(text))]:
        block = text[start:block_end].rstrip()
        offset, start = start, next_start
        begin = len(block) - len(block.lstrip())
        if not block:
            continue
        quotes = [m.span() for m in _QUOTED.finditer(block)]
        q, quoted_to = 0, -1
        for m in positions.finditer(block):
            p = m.end()
            if p >= len(block):
                break
            while q < len(quotes) and quotes[q][0] < p:
                quoted_to = quotes[q][1]
                q += 1
            if p < quoted_to:
                continue
            rule = rules.match(block, p)
            if rule is not None and breaks[rule.lastindex - 1] and p > begin:
                out.append((offset + begin, offset + p))
                begin = p
                while block[begin].isspace():
                    begin += 1
        out.append((offset + begin, offset + len(block)))
    return out


ENDS = "doc_id bigint, sent_end int"


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ids, ends = [], []
        for doc_id, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"]):
            found = [end for _, end in sentence_spans(text, lang)]
            ids += [doc_id] * len(found)
            ends += found
        yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "sent_end": pd.Series(ends, dtype="int32")})


def _units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [
            (doc_id, k, start, end, text[start:end])
            for doc_id, text, lang in zip(frame["doc_id"], frame["text"], frame["lang"])
            for k, (start, end) in enumerate(sentence_spans(text, lang))
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "sent_no", "sent_start", "sent_end", "sentence"])


def _input(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")


def sentence_ends(documents: DataFrame) -> DataFrame:
    """``doc_id, sent_end``: a row for each sentence, the code points of the text up to its end."""
    return _input(documents).mapInPandas(_ends, ENDS)


def sentences(documents: DataFrame) -> DataFrame:
    """``doc_id, sent_no, sent_start, sent_end, sentence``: the sentences with their places in the text."""
    return _input(documents).mapInPandas(_units, "doc_id bigint, sent_no int, sent_start int, sent_end int, sentence string")
