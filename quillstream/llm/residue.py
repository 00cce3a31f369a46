"""Template residue, filler, error messages and notices that scripts are needed (problem 2).

Each sentence (problem 8's units) is read by one grammar per delimiter family for placeholders never
filled in, one for values never filled in, one for filler, and phrase grammars for messages and
notices, which must make up the whole sentence. Code (fenced or between back-ticks) and quoted words
are left out first, and sentences that explain replacing a placeholder are discounted. Filler
words count by density: a sentence is filler if most of its words are.

Defined results: a null, empty or blank text holds no residue; repeated rows are judged alike; rows with
a null ``doc_id`` are left out of ``found`` and kept by ``clean_documents``; a table's other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.sentences import sentence_spans

_NAME = r"[A-Za-zЀ-ӿ][\w.]{2,40}(?:[ -][A-Za-z]\w{0,30}){0,3}"
_UPPER = r"[A-Z][A-Z0-9]+(?:[_ .][A-Z0-9]+){0,4}"
#: One grammar for each family of delimiters.
PLACEHOLDERS = {
    "braces": rf"\{{\{{\{{?\s*[#/^&>]?\s*{_NAME}(?:\s*\|\s*\w+)?\s*\}}?\}}\}}",
    "brace": rf"(?<![\w{{$#%]){{\s*{_NAME}\s*}}(?!\}})",
    "statement": r"\{%-?\s*[\w.][^%{}\n]{0,60}?-?%\}",
    "dollar": rf"\$\{{\s*{_NAME}\s*\}}",
    "hash": rf"#\{{\s*{_NAME}\s*\}}",
    "angle-percent": r"<%[=-]?\s*[\w.@][^%<>\n]{0,60}?%>",
    "angles": rf"<<\s*{_NAME}\s*>>",
    "entity": rf"&lt;\s*{_NAME}\s*&gt;",
    "squares": rf"\[\[\s*{_UPPER}\s*\]\]",
    "square": rf"(?<!\[)\[\s*{_UPPER}\s*\](?!\])",
    "underscores": rf"(?<!\w)__{_UPPER}__(?!\w)",
    "percents": rf"%%{_UPPER}%%",
    "percent": rf"(?<![\w%])%{_UPPER}%(?![\w%])",
    "ats": rf"@@{_UPPER}@@",
    "star-pipe": rf"\*\|{_UPPER}\|\*",
}
VALUES = r"\[object \w+\]|\bInvalid Date\b|\bNaN\b|\b(?:by|on|for|to|from|at|dear|hello|hi) (?:undefined|null|None)\b|\b(?:null|undefined|None)(?:, ?(?:null|undefined|None))+"

#: The words of the customary Latin filler (fixed values).
FILLER_WORDS = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
    "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_FILLER_PARTS = ("ipsum", "dolor", "consectetur", "eiusmod", "incididunt", "exercitation", "voluptate", "excepteur", "proident", "cupidatat", "aliqua", "nulla", "cillum")

_THING = r"(?:page|story|article|document|address|link|url|item|entry|post|file|folder|resource|content|episode|video|view)"
_SITE = r"[\w-]+(?:\.[\w-]+)+"
_JS = r"(?:java ?script|js|scripts?|scripting|script support|client-side code)"
#: Phrases that make up a whole sentence, by kind; matched without regard to case.
FILLER = [
    rf"(?:your|insert|put|add|write|enter|type|place) (?:\S+ ){{0,6}}here",
    r"(?:\S+ ){1,3}(?:goes|go) here",
    r"replace this with .*|(?:this is )?(?:a )?(?:dummy|placeholder|sample|filler) (?:text|content|post)",
    r"welcome to your new (?:blog|site|website)|this is your (?:very )?first (?:entry|post|page)|edit or delete it, then start \S+",
    r"(?:tbd|tba|todo|fixme|coming soon|wip)\b(?!.{60}).*|test post please ignore|test(?:ing)?(?: test)*(?: \d+)+",
    r"x+(?: x+){2,}|(?:blah[ ,]*){2,}|(?:(?:asdf|qwerty|uiop|jkl|hjkl|zxcv)\s*){2,}",
    # German, French, Spanish, Russian, Japanese, Chinese
    r"er füllt nur den platz|dies ist (?:nur )?ein (?:muster|blind|platzhalter|beispiel)text|hier (?:folgt|steht|kommt|entsteht) (?:noch|später|bald) .{1,40}",
    r"(?:votre|ton) \S+ ici|(?:texte|contenu|titre|résumé) (?:à venir|d’exemple.*)|ceci est un (?:faux )?texte.*",
    r"texto de (?:relleno|ejemplo)|aquí irá .{1,40}|escriba aquí .{1,40}|(?:su|tu) \S+ aquí",
    r"здесь будет .{1,40}|это (?:пример|образец) для заполнения .{1,20}|(?:текст|пример) (?:текста|для примера)",
    r"ここに.{1,12}が入ります|これは(?:仮|ダミー)の.{1,8}です|(?:此处|这里)为.{1,6}(?:文本|内容|文字)|请在此(?:输入|填写).{1,8}",
]
ERRORS = [
    rf"(?:error|fehler|erreur|ошибка|error code|code|vorgang|reference|ray|check id|status|http|código(?: de error)?|错误代码)\s*[:：#№]*\s*#?(?=[\w.]*\d)[0-9a-f.]{{3,}}",
    r"[45]\d\d(?:\s?エラー|(?:[ -](?-i:[A-Z][\w-]*|not|to|many|of)){0,5})",
    rf"(?:the|this|that|your) {_THING}\b.{{0,60}}\b(?:not found|could not be found|does not exist|is not on this server|is gone|no longer exists)\b.{{0,40}}",
    rf"(?:the|this) {_THING} was (?:removed|deleted|withdrawn|moved|taken down)\b.{{0,60}}",
    rf"we (?:lost|could ?n[o’']t find|can[’']?t (?:seem to )?find|cannot find|have no trace of|are unable to find) (?:the|that|your) {_THING}\b.{{0,40}}",
    r"it may have moved, or .{1,30}|(?:missing|dead|unknown) page|(?:page )?(?:gone|removed|not found)|oops|uh-?oh|hmm+|sorry",
    rf"(?:use the (?:menu|search)|check the address|try the search box|go back|start again)\b.{{0,60}}\b(?:home ?page|start|front page|menu|home)",
    r"(?:access|permission) (?:denied|forbidden)|forbidden|restricted area|not authori[sz]ed|unauthori[sz]ed|(?:login|log-in|sign-in) required|session (?:expired|ended)|signed out|logged out",
    r"your session has (?:ended|expired|timed out)|please (?:log|sign) in(?: again)? to .{1,40}|you (?:do not have permission|have no permission|lack the rights?|are not allowed) to .{1,80}",
    r"(?:internal )?server error|(?:bad gateway|gateway time-?out|service (?:temporarily )?unavailable|server unavailable|too many requests|rate limit exceeded|slow down)",
    rf"(?:we[’']ll|we will) be (?:right )?back.{{0,20}}|thanks? (?:you )?for your patience|(?:down for|scheduled|under) (?:maintenance|downtime)|{_SITE} is (?:down|offline|paused|closed) for .{{1,40}}",
    r"you have (?:used up|reached|gone over|exceeded) the limit of .{1,30}|(?:retry|try) later|(?:reload|come back|retry) in .{1,20}|wait \d+ .{1,12} before the next .{1,12}|please (?:try again|retry) .{1,30}",
    r"something went wrong.{0,30}|we ran into a problem.{0,30}|an error (?:has )?occurred.{0,30}|the upstream did not answer in time|the query could not be run|error establishing a database connection",
    r"this either means that .{1,40} or that the (?:database )?server cannot be reached|nginx|openresty|apache|cloudflare",
    r"(?:stack trace|fatal error|parse error|uncaught \w+):.*|traceback \(most recent call last\).*|file /\S+, line \d+.*|exception in thread .*|thrown in /\S+ .*|\w*(?:exception|error) at \w+:\d+|(?:key|index|value|type|name)error: .*",
    r"\{\s*\"(?:error|message|status|code)\":.*\}",
    rf"(?:this content is )?not available in your (?:country|region)|{_SITE} does not (?:show|offer|serve) this .{{1,40}}",
    rf"one more step|just a moment|are you (?:a )?(?:human|robot)|checking your browser.{{0,40}}|{_SITE} (?:is checking|needs to review|is reviewing) .{{1,40}} before you .{{1,20}}",
    r"loading|(?:loading, )?please wait(?: while .{1,30})?",
    r"da ist etwas schiefgegangen|kein zutritt|zugriff verweigert|wartungsarbeiten|wir bauen um|zurück zur startseite|(?:seite )?nicht gefunden|(?:interner )?serverfehler",
    rf"sie haben keine (?:berechtigung|rechte) für .{{1,30}}|{_SITE} ist .{{1,20}} wieder erreichbar|bitte versuchen sie es .{{1,40}}|die (?:gesuchte|gewünschte|aufgerufene) seite .{{1,50}}",
    r"accès (?:refusé|interdit)|page introuvable|service indisponible|erreur interne du serveur|retour à l[’']accueil|veuillez réessayer .{1,30}|vous n[’']êtes pas autorisé à .{1,40}|la page (?:demandée|recherchée) .{1,40}",
    r"¡?vaya|prohibido|acceso (?:denegado|prohibido)|página no encontrada|servicio no disponible|error interno del servidor|volver al inicio|inténtelo de nuevo .{1,30}|no tiene permiso para .{1,40}|la página que (?:pide|busca) .{1,40}",
    r"доступ запрещ[её]н|нет доступа|страница не найдена|сайт временно недоступен|внутренняя ошибка сервера|вернуться на главную|повторите попытку .{1,30}|у вас нет прав .{1,40}|(?:нужная|запрошенная) страница .{1,40}",
    r"しばらくしてから.{1,24}|サーバーエラー|トップへ戻る|お探しの.{1,10}(?:ありません|存在しません|終了しました|削除されました|見つかりません)|.{1,10}が見つかりません|アクセスが拒否されました|閲覧できません|混み合っています|ただいまメンテナンス中です|.{1,8}を(?:閲覧|表示)する権限がありません",
    r"您没有权限.{1,12}|访问被拒绝|禁止访问|返回首页|页面不存在|找不到页面|服务器内部错误|服务暂不可用|请稍后再试|请在.{1,6}后重试|您访问的.{1,6}(?:不存在|已被删除或移动)",
]
SCRIPTS = [
    rf".{{0,80}}\b(?:enable|turn(?:ing)? on|switch(?:ing)? on|allow|activate|requires?|needs?|depends on|relies on|without)\s+{_JS}\b.{{0,100}}",
    rf"(?:.{{0,40}}\b)?{_JS} (?:is|are|has been|have been) (?:off|disabled|blocked|not running|switched off|turned off|deactivated)\b.{{0,80}}",
    r"your browser does not (?:have|support) the features? .{1,100}",
    r"(?:noscript: ?)?content is loaded by script",
    r".{0,60}\b(?:java ?script|skripten?)\b.{0,40}\b(?:abgeschaltet|deaktiviert|blockiert|ausgeschaltet)|.{0,60}\b(?:benötigt|braucht|nur mit) (?:javascript|skripten?)|bitte (?:aktivieren|erlauben) sie (?:javascript|skripte)\b.{0,60}",
    r".{0,40}\ba besoin de (?:javascript|scripts)|veuillez (?:activer|autoriser) (?:javascript|les scripts)\b.{0,60}|.{0,40}\b(?:javascript|scripts?) (?:est|sont) (?:désactivée?s?|bloquée?s?).{0,30}",
    r".{0,40}\b(?:javascript|scripts) (?:desactivados?|bloqueados?)|(?:active|permita|habilite) (?:javascript|los scripts)\b.{0,60}|.{0,40}\bnecesita (?:javascript|scripts)",
    r"(?:включите|разрешите) (?:javascript|скрипты)\b.{0,60}|.{0,40}\b(?:отключены|заблокированы|отключ[её]н) (?:скрипты|javascript)",
    r".{0,60}(?:javascript|スクリプト)(?:が無効になっています|を有効にしてください)|请(?:启用|打开|允许)(?:javascript|脚本功能|脚本).{0,20}|您的浏览器已(?:屏蔽|禁用)(?:脚本|javascript)",
]
#: Words by which a sentence explains a placeholder instead of holding it.
EXPLAINS = r"\breplac(?:e|es|ed|ing)\b.*\b(?:with|by)\b|\btemplate language\b|\bmarks? a gap\b|\bersetz\w*|\bplatzhalter\b|\bremplac\w+|\bcambiar\b|\breemplaz\w+|замен\w+|\bsyntax\b|\bplaceholders?\b"

_PLACEHOLDER = re.compile("|".join(rf"(?<!\\)(?:{p})" for p in PLACEHOLDERS.values()))
_VALUE = re.compile(VALUES)
_EXPLAINS = re.compile(EXPLAINS, re.I)
_ERROR, _SCRIPT = (re.compile("|".join(phrases), re.I | re.S) for phrases in (ERRORS, SCRIPTS))
#: Parts of which a text or sentence must hold one for values, notices and Latin filler to be looked for; lower case.
_VALUE_PARTS = ("null", "undefined", "none", "nan", "[object", "invalid date")
_SCRIPT_PARTS = ("script", "skript", " js", "browser", "client-side", "скрипт", "スクリプト", "脚本")
_REPEATED = re.compile(r"(\S{2,})(?: \1){2,}")
_FILLER = re.compile("|".join(FILLER), re.I | re.S)
_CODE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*(?:\n[^`\n]*)?`", re.S)
_QUOTED = re.compile(r"“[^“”]*”|«[^«»]*»|„[^„“”]*[“”]|「[^「」]*」|『[^『』]*』|(?<![\w{:,\[])\"[^\"{}]*\"(?!\s*[:,}])")
_QUOTES = re.compile("[“«„「『\"]")
_ENDS = " \t\n.!?…。！？:：-–—*•#"
_SPACES = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_MARKED = re.compile(r"[{}<>\[\]_%@*&#$]")


def _filler(sentence: str) -> bool:
    words = _WORD.findall(sentence.lower())
    return len(words) >= 3 and sum(w in FILLER_WORDS for w in words) * 10 >= len(words) * 7


def _holds(text: str, parts: tuple[str, ...]) -> bool:
    return any(p in text for p in parts)


def residue_kind(sentence: str, values: bool = True, scripts: bool = True, latin: bool = True) -> str | None:
    """What kind of residue the sentence is or holds, if any; the flags tell what to look for."""
    bare = _QUOTED.sub(" ", sentence) if _QUOTES.search(sentence) else sentence
    if _MARKED.search(bare) and _PLACEHOLDER.search(bare) and not _EXPLAINS.search(bare):
        return "placeholder"
    if values and _VALUE.search(bare):
        return "value"
    if latin and _filler(bare):
        return "filler"
    if len(sentence) > 240:
        return None
    whole = _SPACES.sub(" ", sentence if sentence.startswith("{") else bare).strip(_ENDS)
    if not whole:
        return "filler" if len(sentence) > 4 and not any(c.isalnum() for c in sentence) and set(sentence) <= set("-–—*=_. \n") else None
    if scripts and _holds(whole.lower(), _SCRIPT_PARTS) and _SCRIPT.fullmatch(whole):
        return "scripts"
    if _ERROR.fullmatch(whole):
        return "error"
    return "filler" if _FILLER.fullmatch(whole) or _REPEATED.fullmatch(whole) else None


def residues(text: str | None, lang: str | None = None) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of each sentence of ``text`` that is or holds residue."""
    if not text:
        return []
    if "`" in text or "~~~" in text:
        text = _CODE.sub(lambda m: " " * len(m[0]), text)
    low = text.lower()
    look = (_holds(low, _VALUE_PARTS), _holds(low, _SCRIPT_PARTS), _holds(low, _FILLER_PARTS))
    out = []
    for start, end in sentence_spans(text, lang):
        sentence = text[start:end]
        kind = residue_kind(sentence, *look)
        if kind is None and "\n" in sentence and end - start <= 240:
            # messages may stand line by line without any mark
            kind = next((k for line in sentence.split("\n") if (k := residue_kind(line, *look)) in ("error", "scripts") and len(line.split()) > 1), None)
        if kind is not None:
            out.append((start, end, kind))
    return out


def _first_kind(texts: pd.Series, langs: pd.Series) -> list[str | None]:
    return [next((k for *_, k in residues(t, lang)), None) for t, lang in zip(texts, langs)]


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        kinds = _first_kind(frame["text"], frame["lang"])
        yield frame.loc[[k is not None for k in kinds], ["doc_id"]]


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = [(d, a, b, k, t[a:b]) for d, t, lang in zip(frame["doc_id"], frame["text"], frame["lang"]) for a, b, k in residues(t, lang)]
        yield pd.DataFrame(rows, columns=["doc_id", "sent_start", "sent_end", "kind", "sentence"])


def _read(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of each row whose text is or holds residue."""
    return _read(documents).mapInPandas(_found, "doc_id bigint")


def residue_sentences(documents: DataFrame) -> DataFrame:
    """The sentences that are or hold residue, with their places and kinds."""
    return _read(documents).mapInPandas(_rows, "doc_id bigint, sent_start int, sent_end int, kind string, sentence string")


def clean_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` free of residue, with all their columns, in one pass over the table."""

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.loc[[k is None for k in _first_kind(frame["text"], frame["lang"])]]

    return documents.mapInPandas(keep, documents.schema)
