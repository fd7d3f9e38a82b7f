import duckdb
import pandas as pd
import pytest

from quarry.llm import quality


PROSE = "the quick brown fox jumps over a lazy dog near some old river bank today."


def judge(text):
    return quality.judged([text.encode()], 0.5)[0]


@pytest.mark.parametrize(
    ("line", "rule"),
    [
        ("", None), (" \t", None), (PROSE, None), ("one## two** three$$ four", "symbols"), ("a | b | c | d", "navigation"),
        ("Home About Contact", "navigation"), ("© 2020 All rights reserved.", "boilerplate"), ("BUY!! NOW!! THIS!! day", "punctuation"),
        ("What a day! He said so.", None), ("Startseite | Suche Kontakt", "navigation"), ("Accueil Connexion Aide", "navigation"), ("Inicio Buscar Ayuda", "navigation"),
        ("© 2020 Alle Rechte vorbehalten", "boilerplate"), ("Cliquez ici pour lire la suite", "boilerplate"), ("Al navegar usted puede aceptar cookies", "boilerplate"),
        ("Die Suche nach einem neuen Haus dauerte zwei lange Jahre.", None), ("Il est de retour avec une aide pour tous.", None), ("El año anterior fue el inicio de todo.", None),
    ],
)
def test_line_rules(line, rule):
    assert quality.line_fails(line.encode()) == rule


def test_figures():
    x = judge("é ab\x1fc #\né ab\x1fc #\n\n")
    assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (6, 12, 2, 1, 0)
    x = judge("a b c d e a b c d e")
    assert x["n_repeat_words"] == 10 and x["base_failed"] and not x["kept"]
    good = judge(PROSE + "\nHome About Contact\n" + PROSE.upper())
    assert good["kept"] and good["cleaned"].decode() == PROSE + "\n" + PROSE.upper()
    assert not judge(PROSE + "\n" + "a% b% c% d% e% f% g% h% i% j% " * 1 + "k%% " * 40)["kept"]


def test_frame_and_sql(spark):
    texts = [None, "", PROSE, PROSE, PROSE + "\n" + PROSE, "x " * 9, "é | b | c\n" + PROSE, "a## b## " * 30, "word " * 30000, "Home About\n" + PROSE, "WOW!! YES!! NO!! " * 8 + "\n"]
    docs = spark.createDataFrame([(i if i != 3 else 2, t, "s", 5, "dup") for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long, kept string")
    got = quality.quality(docs, cleaned=False).drop("n_lines_removed")
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [i if i != 3 else 2 for i in range(len(texts))], "text": texts}))
    want = con.execute(quality.SQL["op3_quality"])
    assert [c[0] for c in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    kept = quality.clean_documents(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted(r.text for r in kept.collect()) == sorted([PROSE, PROSE, "é | b | c\n" + PROSE if not quality.line_fails("é | b | c".encode()) else PROSE, PROSE])
    assert quality.quality(docs.limit(0)).count() == 0


def test_other_languages_in_frame_and_sql(spark):
    texts = [f"{line}\n{PROSE}" for line in ("Startseite Hilfe", "Todos los derechos reservados", "TOUS DROITS d'auteur", "Der Kontakt zu den Nachbarn war gut")]
    got = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(4), "text": texts}))
    rows = con.execute(quality.SQL["op3_quality"]).fetchall()
    assert sorted(map(tuple, got.drop("cleaned", "n_lines_removed").collect())) == sorted(rows)
    assert [r.cleaned for r in got.orderBy("doc_id").collect()] == [PROSE] * 3 + [texts[3]]


def spelt(*numbers):
    """Letters for numbers: digits don't tell templates apart."""
    return "".join(chr(ord("a") + int(c)) for n in numbers for c in f"{n}9")


def footers(i):
    """A document of its own words, with seven lines that stand in many documents: none is in a list of phrases."""
    own = lambda k: f"Page {spelt(i, k)} says {spelt(k, i)} and {spelt(k, k, i)} at length {spelt(i, k, i)}."
    lines = [
        f"(c) {1990 + i % 30} Example Press, Incorporated.", "Please log in to leave a comment.", "Tell your friends about this page!", "Diese Angaben erfolgen ohne Gewähr.",
        "El editor no se responsabiliza de las opiniones.", "Printed from our archive of articles.", "Report a problem with this page.",
    ]
    return "\n".join(x for k, line in enumerate(lines) for x in (own(k), line if i % 2 else "  " + line.upper().replace("Ä", "ä").replace("Ñ", "ñ"))) + "\n\n" + own(99)


def recurring_corpus():
    near = [f"The first line of a copied text number {spelt(i) if i % 9 == 0 else 'one'} here.\nThe second line is the same in all of them.\nAnd a third line ends it all, word for word." for i in range(60)]
    shared = [f"Doc {spelt(i)} starts with words {spelt(i)} all its own.\nA passage that is shared begins here today.\nIts second line is always the same one.\nIts third line ends the passage for good.\nDoc {spelt(i)} goes on in its own manner." for i in range(60)]
    only = ["Please log in to leave a comment.\nReport a problem with this page."]
    within = ["\n".join(f"Verse {spelt(i)} of a song with words of its own.\nThis is the chorus of the song." for i in range(60))]
    return [footers(i) for i in range(60)] + near + shared + only + within + [None, "", "A single line of one document only. " * 2]


def plain_recurring(texts):
    """Templates by counting in plain Python: every line's surroundings, the first of its template in a document."""
    import collections
    import re

    ways, total = collections.defaultdict(list), 0
    for text in texts:
        lines = [x.split() for x in (text or "").split("\n") if x.split()]
        seen = set()
        for i, own in enumerate(lines):
            shape = re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), " ".join(own)))
            if len(lines) > 1 and 3 <= len(own) <= 25 and not quality.line_fails(" ".join(own).encode()) and shape not in seen:
                seen.add(shape)
                ways[shape].append((tuple(lines[i - 1][-3:]) if i else (), tuple(lines[i + 1][:3]) if i + 1 < len(lines) else ()))
                total += 1
    return {k for k, v in ways.items() if len(set(v)) >= 20 and 2 * len(set(v)) >= len(v) and 20_000 * len(set(v)) >= total}


def test_lines_that_recur(spark):
    texts = recurring_corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = plain_recurring(texts)
    assert quality.recurring(docs) == {quality.template(x.encode().split()) for x in want}
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    for i in range(60):
        kept = got[i].cleaned.split("\n")
        assert [x for x in kept if x] == [x for x in footers(i).split("\n")[::2] if x] + [footers(i).split("\n")[-1]] and got[i].kept
        assert "third line ends it all" in got[60 + i].cleaned and got[60 + i].cleaned == texts[60 + i]
        assert "Its second line is always" in got[120 + i].cleaned  # inside of a passage
    assert not got[180].kept and got[180].cleaned == ""  # nothing else is left
    assert got[181].cleaned == texts[181]  # in one document only
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    rows = con.execute(quality.SQL["op3_quality"]).fetchall()
    assert sorted(map(tuple, quality.quality(docs, cleaned=False).drop("n_lines_removed").collect())) == sorted(rows)
    assert {r.text for r in quality.clean_documents(docs).collect()} == {r.cleaned for r in got.values() if r.kept}
    assert quality.recurring(docs.limit(0)) == frozenset()
