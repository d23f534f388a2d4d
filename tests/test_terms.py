"""Term mining against plain Python, containment anywhere in a longer term, dictionaries and answers."""

import random
import re
from collections import Counter, defaultdict

from tallyframe.operators import terms

RUN = re.compile(r"[A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)+")


def plain(texts, least=3):
    forms = defaultdict(Counter)
    for t in texts:
        for run in RUN.findall(t or ""):
            if len(run.split()) <= terms.MOST_WORDS:
                forms[run.lower()][run] += 1
    kept = {k: c for k, c in forms.items() if sum(c.values()) >= least}
    total = {k: sum(c.values()) for k, c in kept.items()}
    out = {}
    for k, c in kept.items():
        w = k.split()
        inside = [o for o in kept if len(o.split()) > len(w) and any(o.split()[i : i + len(w)] == w for i in range(len(o.split()))) and total[o] >= total[k]]
        if not inside:
            term = min(c, key=lambda f: (-c[f], f))
            out[k] = (term, total[k], sorted(set(c) - {term}))
    return out


def test_terms_against_plain_python(spark):
    rnd = random.Random(3)
    names = ["North Sea Fund", "Sea Fund", "North Sea", "Old NORTH Sea Fund", "Vantara Capital", "VANTARA Capital", "Capital Partners", "A B C D E F G H"]
    texts = [" ".join(rnd.choice([*names, "and", "of the", "went."]) + rnd.choice([" and", ",", "\n"]) for _ in range(rnd.randint(0, 6))) for _ in range(80)] + [None, "", "lower case only", "One"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    got = {r.key: (r.term, r.n, r.variants) for r in terms.canon(rows, []).collect()}
    assert got == plain(texts) and len(got) > 3
    assert terms.canon(rows.where("false"), []).count() == 0


def test_inside_a_longer_term_is_anywhere(spark):
    rows = [("north sea fund", 5), ("sea fund", 5), ("north sea", 6), ("sea", 4), ("fund", 9), ("north fund", 1)]
    df = spark.createDataFrame([("d", *r) for r in rows] + [("e", "sea fund", 2)], "deck_id string, key string, n long")
    got = {(r.deck_id, r.key) for r in terms.drop_subsumed(df, ["deck_id"]).collect()}
    assert got == {("d", "north sea fund"), ("d", "north sea"), ("d", "fund"), ("d", "north fund"), ("e", "sea fund")}


def test_forms_places_dictionary_and_answers(spark):
    said = [("d", 1, "Vantara Capital met Vantara Capital"), ("d", 2, "VANTARA Capital and Annual Report"), ("d", 3, "Annual Report, Annual Report; Vantära Capital"), ("e", 1, "Vantara Capital")]
    texts = spark.createDataFrame(said, "deck_id string, slide int, text string")
    found = terms.phrases(texts, ["deck_id"], "text", "slide")
    assert {(r.deck_id, r.form, r.n, r.places) for r in found.collect()} >= {("d", "Vantara Capital", 2, 1), ("d", "Annual Report", 3, 2), ("e", "Vantara Capital", 1, 1)}
    grouped = terms.groups(found, ["deck_id"])
    rows = {r.key: r for r in grouped.collect()}
    assert set(rows) == {"vantara capital", "annual report"} and rows["vantara capital"].variants == ["VANTARA Capital", "Vantära Capital"] and not rows["vantara capital"].only_case
    ordinary = spark.createDataFrame([("annual",), ("Report",), ("capital",)], "word string")
    assert [r.key for r in terms.distinctive(grouped, ordinary).collect()] == ["vantara capital"]
    assert {r.word for r in terms.client_words(found, ordinary, ["deck_id"]).where("deck_id = 'd'").collect()} == {"Vantara", "Vantära"}
    answers = spark.createDataFrame([("vantara capital", "VANTARA Capital")], "key string, term string")
    settled = {r.key: r for r in terms.with_answers(grouped, answers).collect()}
    assert settled["vantara capital"].term == "VANTARA Capital" and settled["vantara capital"].variants == ["Vantara Capital", "Vantära Capital"] and settled["annual report"].variants == []
