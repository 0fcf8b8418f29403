"""Spelling variants: words one edit apart, found by walking a distributed trie level by level."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.llm.common import Workspace, on_workers
from tracklens.llm.skew import join_unique

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form has at least so many times its variant's occurrences.
FORM_TIMES = 5
#: One of so many runs loses a letter.
DAMAGED = 199
#: Distinct words and their characters that a task adds up before it passes them on.
HELD_WORDS, HELD_CHARS = 200_000, 8_000_000
#: Prefixes up to this length name their trie node, longer ones by a 128-bit hash.
NAMED = 48
BATCH = 256


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_letters: int = MIN_LETTERS, damaged: int | None = DAMAGED
) -> DataFrame:
    """``word, n`` of the distinct words of ``min_letters`` code points or more, over whole texts.

    Words are maximal runs of Latin letters, A-Z in lower case. With ``damaged``, a run loses the letter at ``h % length`` where
    the crc32 ``h`` of ``<key>:<run>`` is a multiple of it (a null key is empty there). Tasks add up their own words first.
    """
    on_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[a-zÀ-ÿ]{{{min_letters},}}")
        held: Counter[str] = Counter()
        held_chars = 0
        for batch in (b.slice(at, BATCH) for b in batches for at in range(0, b.num_rows, BATCH)):
            for ident, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = runs.findall(whole.encode().lower().decode())
                if damaged:
                    base = zlib.crc32(f"{'' if ident is None else ident}:".encode())
                    for i, run in enumerate(found):
                        h = zlib.crc32(run.encode(), base)
                        if h % damaged == 0:
                            k = h % len(run)
                            found[i] = run[:k] + run[k + 1 :]
                before = len(held)
                held.update(found)
                held_chars += (len(held) - before) * 12 if len(whole) < 1 << 16 else sum(map(len, found))
                if len(held) > HELD_WORDS or held_chars > HELD_CHARS:
                    yield _counted(held)
                    held, held_chars = Counter(), 0
        yield _counted(held)

    rows = docs.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = rows.mapInArrow(count, "word string, n bigint").filter(F.char_length("word") >= min_letters)
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])


def _prefixes(words: DataFrame, shortest: int) -> DataFrame:
    """``side, word, len, node, next`` of every prefix from ``shortest`` letters on, of words (``f``) and of reversed words (``b``).

    ``node`` names the prefix, ``next`` is the letter behind it, empty at the word's end.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 4 * BATCH) for b in batches for at in range(0, b.num_rows, 4 * BATCH)):
            for some in _in_pieces(batch.column(0).to_pylist()):
                side, word, size, node, after = [], [], [], [], []
                for w in some:
                    for s, spelled in (("f", w), ("b", w[::-1])):
                        digest = xxhash.xxh3_128(spelled[:NAMED]) if len(spelled) > NAMED else None
                        for k in range(shortest, len(spelled) + 1):
                            if k > NAMED:
                                digest.update(spelled[k - 1])
                            side.append(s), word.append(w), size.append(k), after.append(spelled[k : k + 1])
                            node.append(s + spelled[:k] if k <= NAMED else f"{s}#{k}#{digest.hexdigest()}")
                        if len(side) > 20_000:
                            yield _prefix_batch(side, word, size, node, after)
                            side, word, size, node, after = [], [], [], [], []
                yield _prefix_batch(side, word, size, node, after)

    return words.select("word").mapInArrow(spell, "side string, word string, len int, node string, next string")


def _in_pieces(words: list[str], chars: int = 100_000) -> Iterator[list[str]]:
    some, n = [], 0
    for w in words:
        some.append(w)
        n += len(w)
        if n > chars:
            yield some
            some, n = [], 0
    yield some


def _prefix_batch(*columns: list) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["side", "word", "len", "node", "next"])


def trie_paths(words: DataFrame, ws: Workspace, shortest: int) -> DataFrame:
    """``side, word, n, spelled, path`` with the trie nodes on each word's way: prefixes of ``shortest`` letters, those that branch and those
    that are words; the stretches between them are single edges."""
    prefixes = ws.put(_prefixes(words, shortest), "prefixes")
    first, last = F.min("next"), F.max("next")
    nodes = prefixes.groupBy("node").agg(F.min("len").alias("_len"), first.alias("_first"), last.alias("_last")).filter(
        (F.col("_len") == shortest) | (F.col("_first") == "") | (F.col("_first") != F.col("_last")))
    nodes = ws.put(nodes.select("node", (F.col("_last") != "").alias("open")), "nodes")
    on_way = join_unique(prefixes, nodes, ["node"])
    path = on_way.groupBy("side", "word").agg(F.sort_array(F.collect_list(F.struct("len", "node", "open"))).alias("path"))
    spelled = F.when(F.col("side") == "f", F.col("word")).otherwise(F.reverse("word"))
    return ws.put(path.join(words, "word").select("side", "word", "n", spelled.alias("spelled"), "path"), "paths")


def trie_nodes(paths: DataFrame, ws: Workspace) -> DataFrame:
    """The edge table, a row per node: ``node, edges`` with the label, the child, the letters that may follow there, and the
    child's occurrences if it is a word. A node has an edge per letter at most."""
    step = F.explode(F.expr("transform(sequence(1, size(path) - 1), i -> struct(path[i - 1] as a, path[i] as b))"))
    rows = paths.filter(F.size("path") > 1).select("n", "spelled", step.alias("e"))
    ends = F.col("e.b.len") == F.char_length("spelled")
    rows = rows.select(
        F.col("e.a.node").alias("node"), F.expr("substring(spelled, e.a.len + 1, e.b.len - e.a.len)").alias("label"),
        F.col("e.b.node").alias("child"), F.expr("substring(spelled, e.b.len + 1, 1)").alias("_next"), F.when(ends, F.col("n")).alias("_n"))
    edges = rows.groupBy("node", "label", "child").agg(F.array_join(F.collect_set("_next"), "").alias("follow"), F.max("_n").alias("n"))
    return ws.put(edges.groupBy("node").agg(F.collect_list(F.struct("label", "child", "follow", "n")).alias("edges")), "edges")


def _landed(rows: DataFrame) -> DataFrame:
    """States on ``e``'s child that can still reach a word: those at its end in a word, and those whose next letter follows there."""
    done = F.col("at") == F.char_length("target")
    alive = F.when(done, F.col("e.n").isNotNull()).otherwise(F.expr("instr(e.follow, substring(target, at + 1, 1)) > 0"))
    return rows.filter(alive).select(
        "side", "word", "n", "target", "at", F.col("e.child").alias("node"), F.when(done, F.col("e.n")).alias("target_n"))


def near_words(words: DataFrame, ws: Workspace, min_letters: int = MIN_LETTERS) -> DataFrame:
    """``word, n, near, near_n`` of every two distinct words that differ by one inserted, deleted or replaced code point, both ways round.

    The trie's edges are a table; a state is a word, the position it has reached, the node and its one edit. Two such words share the
    first half of the shorter one or the last, so edits are made in the second half only: once in the trie of the words, once in that of the reversed
    words. States start where a word's own way leaves a node in that half: the edit takes any other edge (a greater letter replaces the
    word's, or a letter comes in; the two other cases are these seen from the other word). From then on the frontier joins the edges level
    by level, each state following the one edge that spells its word's rest; those that end on a word are its neighbours. An edge tells the letters behind it,
    so states that cannot go on are not made. Hot nodes meet their states by broadcast (:func:`tracklens.llm.skew.join_unique`).
    """
    shortest = min_letters // 2
    paths = trie_paths(words, ws, shortest)
    nodes = trie_nodes(paths, ws)
    half = F.expr("char_length(word) div 2")
    starts = paths.select("side", "word", "n", "spelled", F.explode("path").alias("p")).filter((F.col("p.len") >= half) & F.col("p.open"))
    starts = ws.put(starts.select("side", "word", "n", "spelled", F.col("p.len").alias("at"), F.col("p.node").alias("node")), "starts")
    rows = join_unique(starts, nodes, ["node"]).select("side", "word", "n", "spelled", "at", F.explode("edges").alias("e"))
    # an edge that spells the word's own next letter is its own way, which needs no edit
    rows = rows.filter("substring(e.label, 1, 1) <> substring(spelled, at + 1, 1)").select(
        "*", F.expr("substring(e.label, 2)").alias("_more"), F.expr("substring(spelled, at + 1, 1)").alias("_own"))
    replaced = F.when(
        F.expr("_own <> '' and substring(e.label, 1, 1) > _own and startswith(substring(spelled, at + 2), _more)"),
        F.expr("concat(substring(spelled, 1, at), substring(e.label, 1, 1), substring(spelled, at + 2))"))
    added = F.when(
        F.expr("startswith(substring(spelled, at + 1), _more)"),
        F.expr("concat(substring(spelled, 1, at), substring(e.label, 1, 1), substring(spelled, at + 1))"))
    edited = rows.select(
        "side", "word", "n", F.explode(F.array_compact(F.array(replaced, added))).alias("target"),
        F.expr("at + char_length(e.label)").alias("at"), "e")
    states, found, level = ws.put(_landed(edited), "level-0"), [], 0
    while True:
        found.append(states.filter("target_n is not null"))
        open_states = states.filter("target_n is null")
        if open_states.isEmpty():
            break
        level += 1
        walked = join_unique(open_states.drop("target_n"), nodes, ["node"])
        own = F.filter("edges", lambda e: F.startswith(F.expr("substring(target, at + 1)"), e["label"]))
        walked = walked.withColumn("e", F.get(own, F.lit(0))).filter("e is not null").withColumn("at", F.expr("at + char_length(e.label)"))
        states = ws.put(_landed(walked), f"level-{level}")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    near = F.when(F.col("side") == "f", F.col("target")).otherwise(F.reverse("target"))
    pairs = pairs.withColumn("near", near)
    # what both tries find counts in the first
    once = (F.col("side") == "f") | (F.expr("left(word, char_length(word) div 2) <> left(near, char_length(word) div 2)"))
    pairs = pairs.filter(once).select("word", "n", "near", F.col("target_n").alias("near_n"))
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return ws.put(pairs.select(both.alias("p")).select("p.*"), "pairs")


def _roots(forms: DataFrame, ws: Workspace) -> DataFrame:
    """``word, root``: the end of each chain of forms, each round doubling what a row has followed. Counts rise fivefold from
    a word to its form, so chains end and are short."""
    rows = ws.put(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots-0")
    n = 0
    while not rows.filter("open").isEmpty():
        n += 1
        further = rows.select(F.col("word").alias("root"), F.col("root").alias("_further"), F.col("open").alias("_open"))
        moved = join_unique(rows.filter("open"), further, ["root"], "left")
        moved = moved.select("word", F.coalesce("_further", "root").alias("root"), F.coalesce("_open", F.lit(False)).alias("open"))
        rows = ws.put(moved.unionByName(rows.filter("not open")), f"roots-{n}")
    return rows.drop("open")


def spelling_variants(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_letters: int = MIN_LETTERS,
    min_count: int = MIN_COUNT,
    times: int = FORM_TIMES,
    damaged: int | None = DAMAGED,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with ``min_count`` occurrences or more in whole texts (:func:`word_counts`).

    ``n_near`` counts the words one edit away (:func:`near_words`); the most frequent of them, the first in code-point order among
    equals, is the word's form if it has ``times`` its occurrences, else ``form`` and ``form_n`` are null. ``root`` follows forms to the last, and
    is the word itself without one. Null texts have no words, null keys are empty in the damage rule, repeated rows count again; empty tables
    give empty results. Other columns are ignored, whatever their names. Words may have any length; two prefixes above 48 letters are told
    apart by 128-bit hashes.
    """
    ws = Workspace(docs.sparkSession, "spelling")
    counts = word_counts(docs, key, text, min_letters, damaged)
    words = ws.put(counts.filter(F.col("n") >= min_count), "words")
    pairs = near_words(words, ws, min_letters)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "b")
    held = -F.col("b.less") >= times * F.col("n")
    rows = ws.put(rows.select(
        "word", "n", "n_near", F.when(held, F.col("b.near")).alias("form"), F.when(held, -F.col("b.less")).alias("form_n")), "forms")
    roots = _roots(rows.filter("form is not null").select("word", "form"), ws)
    out = rows.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return ws.result(out.select("word", "form", "root", "n", "n_near", "form_n"))
