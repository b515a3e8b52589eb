"""Free-entered values mapped to a canonical list.

The reference entries and their alias paths form one trie. A value is looked up with a Levenshtein
automaton (with adjacent transpositions) run along the trie: each step moves the automaton's
states, held as bit sets by number of edits, and a branch is left as soon as no state is alive. The
bound depends on the value's length. All entries within the bound are returned, the nearest first.

Alias paths come from the data, not from lists: rows whose stored entry is valid tell which spellings
mean which entry (:func:`every_alias`, an aggregate over all rows); those beyond what one trie should hold are
looked up in tries of their own, each of a share of the paths (:func:`near_paths`). Shortened words ('max rng')
follow a rule (:func:`shortens`) and are read along a second trie, whose edges are whole words.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.plans.runtime import Scratch, broadcast_if_small, parallelism

UNMATCHED = "UNMATCHED"

# Standard abbreviations of technical drawings that are no shortening of their word by rule.
IRREGULAR = {"mfg": "manufacturer", "xmsn": "transmission"}
#: Alias paths of an entry in the trie that every task holds, those with most rows first; the others are looked up in parts.
ALIASES_PER_ENTRY = 500
#: Letters of paths in the trie of a part, and of the words that are looked up in it by one task.
PART_PATHS, PART_WORDS = 200_000, 200_000

# Words before a field name that don't belong to it.
_LEAD = re.compile(r"^(?:(?:the|a|stated|est\.?|estimated|approx\.?|reported|nominal|about)\s+)+")
_BRACKETS = re.compile(r"[\(\[][^\)\]]*[\)\]]")


def plain(text: str) -> str:
    """Field name in one spelling: lower case, no brackets, unit tail, colons or punctuation; 'b, a' as 'a b'."""
    s = unicodedata.normalize("NFC", text).lower().strip()
    s = _BRACKETS.sub(" ", s)
    s = re.sub(r",\s*in\s+\S.*$", "", s.strip())
    s = re.sub(r"[\s:;.]+$", "", s.strip())
    s = _LEAD.sub("", s.replace("_", " "))
    if s.count(",") == 1:
        tail, head = s.split(",")
        s = f"{head} {tail}"
    return re.sub(r"[\s_\-/'’.,]+", " ", s).strip()


def bound(length: int) -> int:
    """Greatest distance by length: short names must be exact, long ones may hold two slips."""
    return 0 if length <= 3 else 1 if length <= 7 else 2


def shortens(short: str, word: str) -> bool:
    """``short`` is a usual shortening of ``word``: its beginning, or its letters in order without inner vowels."""
    if len(short) < 2 or len(short) >= len(word) or short[0] != word[0]:
        return IRREGULAR.get(short) == word
    if word.startswith(short):
        return True
    if any(ch in "aeiou" for ch in short[1:-1]) or (short[-1] in "aeiou" and short[-1] != word[-1]):
        return IRREGULAR.get(short) == word
    letters = iter(word)
    return all(ch in letters for ch in short) or IRREGULAR.get(short) == word


@dataclass
class Node:
    children: dict[str, Node] = field(default_factory=dict)
    entries: list[tuple[str, int]] = field(default_factory=list)  # (canonical entry, 0 own name or 1 alias)


class Lexicon:
    """Trie of canonical entries with alias paths, by letters; and the entries' own names by words."""

    def __init__(self, entries: Iterable[str], aliases: dict[str, list[str]] | None = None):
        self.root, self.by_words = Node(), Node()
        entries = list(entries)
        for entry in entries:
            own = plain(entry)
            for kind, path in [(0, own), *((1, plain(a)) for a in (aliases or {}).get(entry, []))]:
                self._add(self.root, path, entry, kind)
                if " " in path:
                    self._add(self.root, path.replace(" ", ""), entry, kind)
            self._add(self.by_words, own.split(" "), entry, 1)
        self.words: dict[str, Lexicon] = {}
        self.initials: dict[str, list[str]] = {}
        for word in sorted({w for entry in entries for w in plain(entry).split(" ")} - {""}):
            self.words[word] = word_trie = Lexicon([])
            self._add(word_trie.root, word, word, 0)
            self.initials.setdefault(word[0], []).append(word)

    @staticmethod
    def _add(root: Node, path: Iterable[str], entry: str, kind: int) -> None:
        node = root
        for step in path:
            node = node.children.setdefault(step, Node())
        if path and all(e != entry for e, _ in node.entries):
            node.entries.append((entry, kind))

    def within(self, word: str, most: int) -> list[tuple[int, int, str]]:
        """All (distance, kind, entry) with a path at most ``most`` edits from the word, sorted."""
        n = len(word)
        end = 1 << n
        at: dict[str, int] = {}
        for i, ch in enumerate(word):
            at[ch] = at.get(ch, 0) | 1 << i
        best: dict[str, tuple[int, int]] = {}

        stack = [(self.root, [(2 << e) - 1 for e in range(most + 1)], [0] * (most + 1))]
        while stack:
            node, state, swaps = stack.pop()
            # state[e]: bit i is set if e edits lead to place i of the word; swaps[e]: half of an adjacent swap is read
            for e, places in enumerate(state):
                if places & end:
                    for entry, kind in node.entries:
                        if (e, kind) < best.get(entry, (99, 9)):
                            best[entry] = (e, kind)
                    break
            for nxt, child in node.children.items():
                here = at.get(nxt, 0)
                new, half, last, alive = [], [], 0, 0
                for e, places in enumerate(state):
                    v = (places & here) << 1 | (swaps[e] & here) << 2
                    h = 0
                    if e:
                        less = state[e - 1]
                        v |= less | less << 1 | last << 1
                        h = less & here >> 1
                    last = v & (end << 1) - 1
                    new.append(last)
                    half.append(h)
                    alive |= last | h
                if alive:
                    stack.append((child, new, half))
        return sorted((d, k, e) for e, (d, k) in best.items())

    def shortened(self, words: list[str], most: int) -> list[tuple[int, int, str]]:
        """All (distance, 1, entry) whose name the words follow one by one, some shortened, with ``most`` edits in the others."""
        best: dict[str, int] = {}

        def visit(node: Node, k: int, spent: int, short: bool) -> None:
            if k == len(words):
                for entry, _ in node.entries:
                    if short:
                        best[entry] = min(best.get(entry, 99), spent)
                return
            w = words[k]
            for v, child in node.children.items():
                if w == v:
                    visit(child, k + 1, spent, short)
                elif shortens(w, v) and (len(words) > 1 or len(w) > 2):
                    visit(child, k + 1, spent, True)
                elif spent < most and abs(len(w) - len(v)) <= most - spent and len(w) > 3:
                    near = self.words[v].within(w, most - spent)
                    if near:
                        visit(child, k + 1, spent + near[0][0], short)

        if any(shortens(w, v) for w in words for v in self.initials.get(w[0], ())):
            visit(self.by_words, 0, 0, False)
        return sorted((d, 1, e) for e, d in best.items())

    def lookup(self, value: str, more: Iterable[dict] | None = None) -> tuple[str | None, str, int | None, list[str]]:
        """(entry or None, status, distance, all entries within the bound).

        ``more`` has distance and entry of alias paths near the value that this trie doesn't hold.
        status is 'exact' (own name), 'alias', 'fuzzy', 'ambiguous' (several entries equally near) or 'unmatched'.
        """
        word = plain(value)
        if not word:
            return None, "unmatched", None, []
        most = bound(len(word))
        found: dict[str, tuple[int, int]] = {}
        for d, kind, entry in self.within(word, most) + self.shortened(word.split(" "), most) + [(m["distance"], 1, m["entry"]) for m in more or ()]:
            found[entry] = min(found.get(entry, (99, 9)), (d, kind))
        hits = sorted((d, kind, entry) for entry, (d, kind) in found.items())
        if not hits:
            return None, "unmatched", None, []
        names = [e for _, _, e in hits]
        first = hits[0]
        if len(hits) > 1 and hits[1][:2] == first[:2]:
            return None, "ambiguous", first[0], names
        return first[2], ("exact", "alias")[first[1]] if first[0] == 0 else "fuzzy", first[0], names


def alias_counts(rows: DataFrame, value: str, entry: str, reference: list[str], support: int = 2, share: float = 0.8) -> DataFrame:
    """(path, n, entry): spellings that rows with a valid stored entry use for an entry, each path once.

    Counts are over all rows. A spelling needs ``support`` rows and ``share`` of all rows that map it
    for one entry; null, blank or rarer ones are left to the automaton.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted: dict[tuple[str, str], int] = {}
            for v, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counted[v, e] = counted.get((v, e), 0) + 1
            keys = [(plain(v), e, n) for (v, e), n in counted.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                                             names=["path", "entry", "n"])

    mapped = rows.select(F.col(value).alias("v"), F.col(entry).alias("e")).where(F.col("e").isin(reference) & (F.trim("v") != ""))
    counts = mapped.mapInArrow(spell, "path string, entry string, n long").groupBy("path", "entry").agg(F.sum("n").alias("n")).where("path <> ''")
    whole = counts.groupBy("path").agg(F.sum("n").alias("total"), F.max(F.struct("n", "entry")).alias("m"))
    return whole.where((F.col("m.n") >= support) & (F.col("m.n") >= share * F.col("total"))).select("path", F.col("m.n").alias("n"), F.col("m.entry").alias("entry"))


def _most_frequent(counts: DataFrame, per_entry: int) -> dict[str, list[str]]:
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("entry").orderBy(F.desc("n"), "path"))).where(f"r <= {per_entry}")
    out: dict[str, list[str]] = {}
    for r in sorted(ranked.select("entry", "path").collect()):
        out.setdefault(r["entry"], []).append(r["path"])
    return out


def learned_aliases(rows: DataFrame, value: str, entry: str, reference: list[str], per_entry: int = ALIASES_PER_ENTRY,
                    support: int = 2, share: float = 0.8) -> dict[str, list[str]]:
    """The ``per_entry`` alias paths of each entry with most rows; without mapped rows there are none.

    ``per_entry`` bounds what reaches the driver (entries x per_entry short strings); :func:`every_alias`
    has the others too.
    """
    return _most_frequent(alias_counts(rows, value, entry, reference, support, share), per_entry)


def every_alias(rows: DataFrame, value: str, entry: str, reference: list[str], per_entry: int = ALIASES_PER_ENTRY,
                support: int = 2, share: float = 0.8) -> tuple[dict[str, list[str]], DataFrame | None]:
    """The paths of :func:`learned_aliases`, and (path, entry) of all others, None if there are no others."""
    counts = Scratch(rows.sparkSession, "aliases").put(alias_counts(rows, value, entry, reference, support, share))
    first = _most_frequent(counts, per_entry)
    held = [(path, e) for e, paths in first.items() for path in paths]
    if counts.count() == len(held):
        return first, None
    return first, counts.select("path", "entry").join(rows.sparkSession.createDataFrame(held, "path string, entry string"), ["path", "entry"], "left_anti")


def _plain_column(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds :func:`plain` of a column that holds no null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).to_pylist()
            spelled = {v: plain(v) for v in set(values)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([spelled[v] for v in values], pa.string())], names=names)

    at, names = df.columns.index(value), [*df.columns, out]
    return df.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in df.dtypes) + f", `{out}` string")


def near_paths(words: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, near): for each word in plain spelling all entries that have a path within the word's bound, with the distance.

    ``words`` has word, each once; ``paths`` has path and entry, any number of them. Paths are cut by length and hash
    into parts of about PART_PATHS letters, words that may reach a part's length into parts of about PART_WORDS; every
    word meets every such path, by the automaton along a trie of the part.
    """
    spelled = _plain_column(paths, "path", "form").select("entry", F.explode(F.array("form", F.replace("form", F.lit(" "), F.lit("")))).alias("form"))
    scratch = Scratch(words.sparkSession, "paths")
    forms = scratch.put(spelled.where("form <> ''").distinct().withColumn("size", F.length("form")))
    words, n = scratch.put(words), F.length("word")
    most = F.when(n <= 3, bound(3)).when(n <= 7, bound(7)).otherwise(bound(8))
    asked = words.select("word", F.explode(F.sequence(n - most, n + most)).alias("size"))
    cuts = forms.groupBy("size").agg(F.count("*").alias("n")).select("size", F.ceil(F.col("n") * F.col("size") / PART_PATHS).cast("int").alias("shares"))
    loads = scratch.put(asked.join(cuts, "size").groupBy("size", "shares").agg(F.count("*").alias("n")).select(
        "size", "shares", F.ceil(F.col("n") * F.col("size") / PART_WORDS).cast("int").alias("loads")))
    # few bytes and much work: a number of tasks of its own, which adaptive execution doesn't coalesce
    tasks = max(parallelism(words.sparkSession), loads.agg(F.sum(F.col("shares") * F.col("loads"))).first()[0] or 0)
    part = ["size", "share", "load"]
    left = forms.join(loads, "size").select(
        "size", F.pmod(F.xxhash64("form"), "shares").cast("int").alias("share"), F.explode(F.sequence(F.lit(0), F.col("loads") - 1)).alias("load"), "form", "entry")
    right = asked.join(loads, "size").select(
        "size", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.pmod(F.xxhash64("word"), "loads").cast("int").alias("load"), "word")

    def look(own: pa.Table, theirs: pa.Table) -> pa.Table:
        trie = Lexicon([])
        for form, entry in zip(own["form"].to_pylist(), own["entry"].to_pylist()):
            trie._add(trie.root, form, entry, 1)
        found = [(w, e, d) for w in theirs["word"].to_pylist() for d, _, e in trie.within(w, bound(len(w)))]
        return pa.table([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))], names=["word", "entry", "distance"])

    found = left.repartition(tasks, *part).groupBy(*part).cogroup(right.repartition(tasks, *part).groupBy(*part)).applyInArrow(look, "word string, entry string, distance int")
    least = found.groupBy("word", "entry").agg(F.min("distance").alias("distance"))
    return least.groupBy("word").agg(F.collect_list(F.struct("distance", "entry")).alias("near"))


def map_values(rows: DataFrame, key: str, value: str, reference: list[str],
               aliases: dict[str, list[str]] | None = None, more: DataFrame | None = None) -> DataFrame:
    """One row per distinct (key, value) with a non-blank value: key, value, entry, status, distance, candidates.

    Null and blank values give no row; a value without an entry gets entry 'UNMATCHED'. The trie is
    built in each task from the reference list, which is small by nature; values are looked up where
    they are read, each distinct value once per task, so a frequent value causes no shuffle. Only if there are
    ``more`` alias paths (path, entry) than ``aliases`` has, values are joined with what :func:`near_paths` finds.
    """

    whole = more is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(reference, aliases)
        seen: dict[str, tuple] = {}
        for batch in batches:
            keys, values = batch.column(0), batch.column(1).to_pylist()
            found = []
            for v, near in zip(values, batch.column(2).to_pylist() if not whole else repeat(None)):
                if v not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[v] = lexicon.lookup(v, near)
                found.append(seen[v])
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(values, pa.string()), pa.array([f[0] or UNMATCHED for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.int32()),
                 pa.array(["|".join(f[3]) for f in found], pa.string())],
                names=[key, value, "entry", "status", "distance", "candidates"])

    kept = rows.select(key, value).where(F.length(F.trim(F.regexp_replace(value, r"\s", " "))) > 0)
    kind = dict(kept.dtypes)[key]
    if more is not None:
        words = _plain_column(kept.select(value).distinct(), value, "word").where("word <> ''").select("word").distinct()
        near = Scratch(rows.sparkSession, "near").put(near_paths(words, more)).withColumnRenamed("word", "__word")
        kept = _plain_column(kept, value, "__word").join(broadcast_if_small(near), "__word", "left").select(key, value, "near")
    return kept.mapInArrow(run, f"{key} {kind}, {value} string, entry string, status string, distance int, candidates string").dropDuplicates([key, value])
