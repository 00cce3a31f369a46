"""Residue: every delimiter family, what is only discussed, density of filler, and defined results; precision and recall on held-out cases."""

import pytest

from quillstream.llm.residue import clean_documents, found, residue_kind, residue_sentences, residues

HELD_OUT = [
    ("placeholder", "Dear {{ first_name }},"), ("placeholder", "By {{{user.email}}}"), ("placeholder", "Read {title} in under ${minutes} minutes."),
    ("placeholder", "Posted on {% date %} by <%= author %>"), ("placeholder", "Copyright <<company>> #{year}"), ("placeholder", "By &lt;author&gt; today"),
    ("placeholder", "According to [INSERT NAME], it rained."), ("placeholder", "[[COMPANY]]: now"), ("placeholder", "From __CITY__ and %%DATE%%"),
    ("placeholder", "Hello %FIRST_NAME%, hello *|EMAIL|* and @@PLACE@@"), ("value", "Written by undefined on Monday"), ("value", "Hello [object Object]!"),
    ("value", "Tags: null, null"), ("filler", "Lorem ipsum dolor sit amet, consectetur."), ("filler", "Your title here"), ("filler", "asdf asdf jkl"),
    ("error", "404 Not Found"), ("error", "The page you asked for could not be found on this server."), ("error", "Access denied"), ("error", "Seite nicht gefunden"),
    ("error", "Veuillez réessayer plus tard."), ("error", "页面不存在"), ("scripts", "Please enable JavaScript to view this page."),
    ("scripts", "This app needs scripts."), ("scripts", "Scripting is disabled in your browser, so a.example cannot be shown."), ("scripts", "Bitte aktivieren Sie JavaScript."),
]
DISCUSSED = [
    "Ada asked why a museum must say “please enable JavaScript” at all.", "Writing “{{ title }}” in the header prints its own name.",
    "The template language marks a gap as `${author}` and fills it.", "Tests that replace [TITLE] with the real headline passed.",
    "Access denied was the title of a sonata by Bo.", "The old demo still shows lorem ipsum where the index should be.",
    "An internal server error cost the parser about 3.5 percent.", "The set {a, b} and the index [i] grew.", "The manuscript needs description and transcripts.",
    "Im Handbuch steht, wie man {{name}} durch den echten Namen ersetzt.", "Of 9 pages, 404 were found.", "El aviso «Página no encontrada» salió 9 veces.",
]


@pytest.mark.parametrize("kind, text", HELD_OUT)
def test_residue_of_each_kind(kind, text):
    assert residue_kind(text) == kind
    assert residues(f"All is well here today. It went on.\n\n{text}\n\nIt ended well.", "en")


@pytest.mark.parametrize("text", DISCUSSED)
def test_discussed_is_no_residue(text):
    assert residues(f"{text} It went on.", None) == []


def test_code_blocks_are_left_out():
    assert residues("Use this:\n\n```\nDear {{ name }},\n```\n\nIt fills the name.", "en") == []


def test_tables(spark):
    rows = [(1, "Fine text.", "en", "a"), (2, "Access denied", "en", "b"), (2, "Access denied", "en", "b"), (3, None, None, "c"), (4, "", "en", None), (None, "404 Not Found", None, "d"), (5, "word " * 50_000, "en", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kind string")
    assert sorted(r.doc_id for r in found(docs).collect()) == [2, 2]
    kept = clean_documents(docs)
    assert kept.columns == docs.columns and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, 5]
    assert {(r.doc_id, r.kind, r.sentence) for r in residue_sentences(docs).collect()} == {(2, "error", "Access denied")}
    assert found(docs.limit(0)).count() == 0 and clean_documents(docs.limit(0)).count() == 0
