import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import canonical, entities

MODELS = "model_id long, release_id int, name string, nomenclature string, primary_equip_code string, ioc_year int, manufacturer string, country_of_origin string, claim_id int"
CLAIMS = "claim_id long, model_id string, entity_mention string, record_title string, quote string, code string"
ROWS = [(1, 1, "SX00000001 Zubkeb Duhfiv Mk 4", "Zubkeb Duhfiv Mk 4", "SX00000001", 1990, "Orrevall Works", "Norway", 0),
        (2, 1, "SX00000002 Zubkeb Duhfiv Mk 9", "Zubkeb Duhfiv Mk 9 ", "SX00000002", 1991, "Orrevall Works", "Spain", 0), (2, 2, "SX00000002 Zubkeb Duhfiv Mk 9", "ZUBKEB DUHFIV MK 9", "SX00000002", 1991, "Orrevall Works", "Spain", 0),
        (3, 1, "AX00000003 Gohrum Kebdag Model 80", "Gohrum Kebdag Model 80", "AX00000003", 2000, "Tasker & Holm", "Norway", 0), (4, 1, "AX00000004 Gohrum Kebdag Model 90", "Gohrum Kebdag Model 90", "AX00000004", 2000, "Vostrel Bureau", None, 0)]


def claims(spark, rows):
    return spark.createDataFrame([(i, None, m, t, q, "clash") for i, (m, t, q, _) in enumerate(rows)], CLAIMS)


CASES = [("Zubkeb Duhfiv Mark Four", None, None, 1), ("zubkeb-duhfiv MK9", None, None, 2), ("Zubkeb Duhfiv Mk 5", None, None, None), ("Zukbeb Duhfiv mk IX", None, None, 2), ("Mod. 80", "family: Gohrum Kebdag", None, 3),
         ("Kebdag, Gohrum (Model 90)", None, None, 4), ("GohrumKebdag Model 80", None, None, 3), ("Gohrum Kebd... Mod. 80", None, None, 3), ("Гохрум Кебдаг 90", None, None, 4), ("SX/OOOOOOO2", None, None, 2), ("sx-1", None, None, 1),
         ("AX00000001", None, None, None), ("Zubkeb Duhfiv", None, None, None), ("the Zubkeb Duhfiv radar", None, "x (in service since 1991) is 5", 2), ("Gohrum Kebdag", None, "IOC 2000", None), ("Gohrum Kebdag", None, "the Gohrum Kebdag, made by Vostrel Bureau has 5", 4),
         ("Zubkeb Duhfiv", "radar, Norway", None, 1), ("Zubkeb Duhfiv", None, "Zubkeb Duhfiv, designed in Spain leads", 2), ("it", None, None, None), (None, None, None, None), ("", "", "", None), ("z" * 50_000, None, None, None), ("Block IV Zubkeb Duhfiv", None, None, None)]


def test_cases(spark):
    got = {r.claim_id: r.model_id for r in entities.match(claims(spark, CASES), spark.createDataFrame(ROWS, MODELS)).collect()}
    assert got == {i: c[3] for i, c in enumerate(CASES) if c[3] is not None}


def test_window_crosses_partitions(spark):
    """Small windows in several partitions find what comparing all pairs finds."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") + rng.choice("bdfgklmnprstvz") for _ in range(2))
    families = sorted({f"{word()} {word()}" for _ in range(150)})
    typed = []
    for f in families:
        k = rng.randrange(1, len(f) - 1)
        typed.append(f[:k] + f[k + 1:] if f[k] != " " and f[k - 1] != " " else f)
    from orrery.plans.runtime import Scratch

    pairs = entities.neighbourhood(spark.createDataFrame([(t,) for t in set(typed)], "name string"), spark.createDataFrame([(f,) for f in families], "family string"), Scratch(spark, "t")).collect()
    found = {(p.name, p.family) for p in pairs}
    missed = [t for t, f in zip(typed, families) if (t, f) not in found]
    assert len(missed) <= 0.01 * len(typed)


def test_empty(spark):
    assert entities.match(claims(spark, []), spark.createDataFrame(ROWS, MODELS)).count() == 0
    assert entities.match(claims(spark, CASES), spark.createDataFrame([], MODELS)).count() == 0


def edits(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i * j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8, unique=True), st.text("abcd", min_size=1, max_size=7), st.integers(0, 2))
def test_automaton_returns_all_entries_in_distance(entries, word, most):
    lexicon = canonical.Lexicon(entries)
    assert {e: d for d, _, e in lexicon.within(word, most)} == {e: edits(word, e) for e in entries if edits(word, e) <= most}


NAMES = ["Maximum range", "Maximum speed", "Engine power", "Length", "Crew", "Unit cost"]


@pytest.mark.parametrize("value,entry", [("maximum range", "Maximum range"), ("MAXIMUM_SPEED:", "Maximum speed"), ("power, engine", "Engine power"), ("est. lenght", "Length"), ("max. rng", "Maximum range"), ("maximumspeed [kn]", "Maximum speed"),
                                         ("Engine power, in kw", "Engine power"), ("vmax", "Maximum speed"), ("coût unitaire", "Unit cost"), ("crew morale rating", None), ("weight", None), ("???", None), ("x" * 10_000, None)])
def test_lookup(value, entry):
    assert canonical.Lexicon(NAMES, {"Maximum speed": ["vmax"], "Unit cost": ["coût unitaire"]}).lookup(value)[0] == entry


@pytest.mark.parametrize("short,word,ok", [("max", "maximum", True), ("rng", "range", True), ("rnge", "range", True), ("wt", "weight", True), ("ctry", "country", True), ("mfg", "manufacturer", True),
                                           ("rage", "range", False), ("m", "maximum", False), ("range", "range", False), ("speed", "range", False), ("ego", "engine", False)])
def test_shortened_words(short, word, ok):
    assert canonical.shortens(short, word) is ok


def test_aliases_are_learned_and_unseen_spellings_still_found(spark):
    """Spellings of mapped rows become paths; held-out ones with slips are found through them; a stray mapping is no alias."""
    mapped = [("vmax", "Maximum speed")] * 3 + [("coût unitaire", "Unit cost")] * 2 + [("price per unit", "Unit cost")] * 4 + [("price per unit", "Crew")] + [("stray", "Crew")] + [(None, "Crew"), ("hull", "no entry"), ("", "Crew")]
    df = spark.createDataFrame([(i, a, e) for i, (a, e) in enumerate(mapped)], "id long, attribute string, entry string")
    aliases = canonical.learned_aliases(df, "attribute", "entry", NAMES)
    assert aliases == {"Maximum speed": ["vmax"], "Unit cost": ["coût unitaire", "price per unit"]}
    held_out = {"V-Max": "Maximum speed", "coût untiaire": "Unit cost", "price per unt": "Unit cost", "stray": None, "hull": None}
    without, learned = canonical.Lexicon(NAMES), canonical.Lexicon(NAMES, aliases)
    assert {v: learned.lookup(v)[0] for v in held_out} == held_out
    assert all(without.lookup(v)[0] is None for v in held_out)
    assert canonical.learned_aliases(df, "attribute", "entry", NAMES, per_entry=1)["Unit cost"] == ["price per unit"]
    assert canonical.learned_aliases(df.limit(0), "attribute", "entry", NAMES) == {}


def test_aliases_beyond_the_bound_of_a_trie_are_found_as_in_one(spark, monkeypatch):
    """Whatever number of paths one trie takes, values come out as with all of them, in parts of any size."""
    rng = random.Random(8)
    paths = sorted({" ".join("".join(rng.choice("abcde") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 4))) for _ in range(300)} | {"w" * 1500})
    mapped = [(p, rng.choice(NAMES)) for p in paths for p in [p, p]]
    learned = {}
    for p, e in mapped:
        learned.setdefault(p, e)
    slips = [p[:k] + rng.choice("abcde") + p[k + 1:] for p in paths for k in [rng.randrange(len(p))]] + [p[1:] for p in paths] + [p.replace(" ", "") for p in paths]
    rows = [(i, p, learned[p]) for i, (p, _) in enumerate(mapped)] + [(10_000 + i, v, None) for i, v in enumerate([*slips, "the length", "lenght", "!", " ", None, "x" * 5000])]
    df = spark.createDataFrame(rows, "id long, attribute string, entry string")
    kept = lambda found: sorted(map(tuple, found.collect()))
    every, none_left = canonical.every_alias(df, "attribute", "entry", NAMES)
    assert none_left is None and every == canonical.learned_aliases(df, "attribute", "entry", NAMES)
    want = kept(canonical.map_values(df, "id", "attribute", NAMES, every))
    assert sum(r[3] == "alias" for r in want) > 600 and sum(r[3] in ("fuzzy", "ambiguous") for r in want) > 100
    for letters in (canonical.PART_PATHS, 400):
        monkeypatch.setattr(canonical, "PART_PATHS", letters)
        monkeypatch.setattr(canonical, "PART_WORDS", 3 * letters)
        first, more = canonical.every_alias(df, "attribute", "entry", NAMES, per_entry=7)
        assert max(map(len, first.values())) == 7 and more.count() == len(paths) - sum(map(len, first.values()))
        assert kept(canonical.map_values(df, "id", "attribute", NAMES, first)) != want
        assert kept(canonical.map_values(df, "id", "attribute", NAMES, first, more)) == want


def test_mapping_rows(spark):
    df = spark.createDataFrame([(1, "length", "e"), (1, "length", "e"), (2, " ", "e"), (3, None, "e"), (4, "motto", "e")], "id long, attribute string, entry string")
    got = {r.id: (r.entry, r.status) for r in canonical.map_values(df, "id", "attribute", NAMES).collect()}
    assert got == {1: ("Length", "exact"), 4: ("UNMATCHED", "unmatched")}
    assert canonical.map_values(df.limit(0), "id", "attribute", NAMES).count() == 0


@pytest.mark.parametrize("value,entry,status,names", [
    ("mast heat", "Mast heat", "exact", ["Mast heat", "Mast head", "Mast beat"]), ("mast hexd", "Mast head", "fuzzy", ["Mast head", "Mast heat"]),
    ("mast hea", None, "ambiguous", ["Mast head", "Mast heat", "Mast beat"]), ("fin", "Fin", "exact", ["Fin"])])
def test_lookup_keeps_all_entries_in_bound(value, entry, status, names):
    found = canonical.Lexicon(["Mast head", "Mast heat", "Mast beat", "Fin", "Fig"]).lookup(value)
    assert (found[0], found[1]) == (entry, status) and sorted(found[3]) == sorted(names) and (entry is None or found[3][0] == entry)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=9), min_size=1, max_size=8, unique=True), st.text("abcd", min_size=1, max_size=9))
def test_candidates_are_all_entries_in_bound(entries, word):
    got = canonical.Lexicon(entries).lookup(word)[3]
    assert sorted(got) == sorted(e for e in entries if edits(word, e) <= canonical.bound(len(word)) or len(word) > 2 and canonical.shortens(word, e))
