"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed against it greedily: each phrase is the
longest match with any substring of the labelled text, found by following transitions from the root until one is
missing. The phrases needed, normalised to an entropy (phrases times the logarithm of the labelled length, by letter),
rank the languages; the least wins.

The automata become one sparse table, a double array: the edges of a state stand at its number plus their symbols, in
places that no other state uses, so it grows with the edges and not with the alphabet. Above ``MOST_ENTRIES`` it is refused.
Texts are cut into blocks of ``BLOCK`` letters that are parsed in step with each other, a lookup for all blocks and
languages at a time. Each block is first parsed from its own beginning; then from the state in which the block before it
ended, until both parses are in the same state. What so changes the end of a block goes on into the next one, so phrases
and longest matches cross blocks as if the text were parsed in one go.

Fit: a bounded sample, ``sample_docs`` texts by language (the least hash in each of as many hash classes, so copies
count once and no sort is needed) and at most ``sample_chars`` letters in total by language, is brought to the driver;
the model is broadcast. Its size is bounded by the number of languages, not by the corpus, and checked. Prediction runs over every
whole text, within the scan.

Edge cases: a null text or one without letters is ``und`` with score 0, as is every text when no row is labelled. Letters
that no labelled text holds end a phrase. Ties go to the language first by name. One language alone wins with score 1.
Repeated rows, null ids, extra columns and empty tables are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import table

if TYPE_CHECKING:
    import pandas as pd

SAMPLE_DOCS, SAMPLE_CHARS = 64, 40_000
BLOCK = 512
MOST_ENTRIES = 1 << 26
#: Letters of blocks, times languages, that are parsed at a time; a block that isn't full takes the memory of a full one.
SLICE = 1 << 21
RESULT = "lang_pred string, score double"


def normalised(text: str) -> str:
    """Lower-case letters, every run of other characters one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class SuffixAutomaton:
    """All substrings of the added symbols; ``edges[state]`` maps a symbol to the next state."""

    def __init__(self) -> None:
        self.edges: list[dict[int, int]] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def add(self, symbol: int) -> None:
        edges, link, length = self.edges, self.link, self.length
        new, at = len(edges), self.last
        edges.append({})
        length.append(length[at] + 1)
        link.append(0)
        while at >= 0 and symbol not in edges[at]:
            edges[at][symbol] = new
            at = link[at]
        if at >= 0:
            there = edges[at][symbol]
            if length[there] == length[at] + 1:
                link[new] = there
            else:
                copy = len(edges)
                edges.append(dict(edges[there]))
                length.append(length[at] + 1)
                link.append(link[there])
                link[there] = link[new] = copy
                while at >= 0 and edges[at].get(symbol) == there:
                    edges[at][symbol] = copy
                    at = link[at]
        self.last = new


def double_array(edges: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the states, and per place the state that owns it (-1: none) and where its edge leads, both as numbers.

    States with several edges take the next places that fit, the others fill what is left between them.
    """
    total = sum(map(len, edges))
    room = 2 * total + 2 * width + 1024
    free, used, base = np.ones(room, bool), np.zeros(room, bool), np.zeros(len(edges), np.int64)
    free[:width] = False
    order = sorted(range(len(edges)), key=lambda s: -len(edges[s]))
    at, step = width, 256
    for s in order:
        symbols = np.fromiter(edges[s], np.int64, len(edges[s]))
        if len(symbols) < 2:
            break
        while True:
            if at + step + width > len(free):
                free, used = np.r_[free, np.ones(len(free), bool)], np.r_[used, np.zeros(len(used), bool)]
            found = np.flatnonzero(free[at : at + step]) + at - symbols.min()
            fits = found[free[found[:, None] + symbols].all(axis=1) & ~used[found]] if len(found) else found
            if len(fits):
                break
            at += step
        base[s], used[fits[0]] = fits[0], True
        free[fits[0] + symbols] = False
    at = width
    for s in order:
        if len(edges[s]) == 1:
            (symbol,) = edges[s]
            p = at
            while not free[p] or used[p - symbol]:
                p += 1
                if p + width >= len(free):
                    free, used = np.r_[free, np.ones(len(free), bool)], np.r_[used, np.zeros(len(used), bool)]
            base[s], used[p - symbol], free[p] = p - symbol, True, False
            at = p + 1
        elif not edges[s]:
            base[s] = np.flatnonzero(~used)[0]
            used[base[s]] = True
    places = np.array([base[s] + c for s, e in enumerate(edges) for c in e], np.int64)
    size = int(max(places.max(initial=0), base.max())) + width + 1
    owner, target = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    owner[places] = np.repeat(base, [len(e) for e in edges])
    target[places] = base[np.array([to for e in edges for to in e.values()], np.int64)]
    return base, owner, target


class Model:
    """langs, the letters with a symbol, and the automata: ``table`` has owner and target of each place in one number,
    ``roots`` the root's number and ``heads`` the state after each symbol from the root, by language.

    Symbol 0 is the space, the last symbol any letter unknown to the model.
    """

    def __init__(self, texts: dict[str, list[str]], most_entries: int = MOST_ENTRIES) -> None:
        self.langs = sorted(texts)
        self.letters = "".join(sorted(set("".join(t for x in texts.values() for t in x)) - {" "}))
        self.width = len(self.letters) + 2
        symbol = {c: i + 1 for i, c in enumerate(self.letters)} | {" ": 0}
        parts, self.roots, self.logs, at = [], [], [], 0
        self.heads = np.zeros((len(self.langs), self.width), np.int32)
        for lang, heads in zip(self.langs, self.heads, strict=True):
            automaton, n = SuffixAutomaton(), 0
            for text in texts[lang]:
                for c in text + " ":
                    automaton.add(symbol[c])
                    n += 1
            base, owner, target = double_array(automaton.edges, self.width)
            parts.append(np.where(owner < 0, -1, owner + at << 32 | target + at))
            self.roots.append(int(base[0]) + at)
            self.logs.append(np.log2(max(n, 2)))
            heads[:] = self.roots[-1]
            for c, to in automaton.edges[0].items():
                heads[c] = base[to] + at
            at += len(owner)
            if at > most_entries:
                raise ValueError(f"the automata take over {most_entries} entries: fit on fewer letters or languages")
        self.table = np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def step(self, lang: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol, and whether a phrase ended before it."""
        found = self.table.take(state + symbol)
        ended = found >> 32 != state
        return np.where(ended, self.heads.ravel().take(lang * self.width + symbol), found & 0xFFFFFFFF), ended

    def symbols(self) -> np.ndarray:
        """The symbol of each code point, after lower-casing; -1 where it is no letter."""
        of = {c: i + 1 for i, c in enumerate(self.letters)}
        other = self.width - 1
        return np.array([of.get(c if len(c := chr(i).lower()) == 1 else chr(i), other) if chr(i).isalpha() else -1 for i in range(0x110000)], np.int32)


@lru_cache(1)
def _symbols(letters: str) -> np.ndarray:
    model = Model({})
    model.letters, model.width = letters, len(letters) + 2
    return model.symbols()


def _parse(model: Model, coded: list[np.ndarray], whole: bool) -> np.ndarray:
    """Phrases of each language (rows) in each coded text (columns); unless ``whole`` a phrase ends with its block."""
    of, blocks, follows = [], [], []
    for i, symbols in enumerate(coded):
        for at in range(0, len(symbols), BLOCK):
            of.append(i)
            blocks.append(symbols[at : at + BLOCK])
            follows.append(at > 0)
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")
    column = np.empty(len(order), np.int64)
    column[order] = np.arange(len(order))
    sizes = sizes[order]
    grid = np.zeros((BLOCK, len(blocks)), np.int64)
    for i, b in enumerate(order):
        grid[: sizes[i], i] = blocks[b]
    active = len(blocks) - np.searchsorted(sizes[::-1], np.arange(BLOCK), side="right")
    langs = np.arange(len(model.langs))[:, None]
    state = np.tile(np.array(model.roots, np.int64)[:, None], (1, len(blocks)))
    states = np.zeros((BLOCK, *state.shape), np.int32)
    ends = np.zeros((BLOCK, *state.shape), bool)
    for step in range(BLOCK):
        n = active[step]
        if not n:
            break
        state[:, :n], ends[step, :, :n] = model.step(langs, state[:, :n], grid[step, :n])
        states[step, :, :n] = state[:, :n]
    after = np.full(len(blocks), -1)
    after[column[:-1][np.array(follows)[1:]]] = column[1:][np.array(follows)[1:]]
    # Blocks to be parsed anew from the state in which the block before them ended, by language.
    before = np.flatnonzero(after >= 0) if whole else np.zeros(0, np.int64)
    lang, at = np.repeat(langs.ravel(), len(before)), np.tile(before, len(langs))
    while len(at):
        state, at = states[sizes[at] - 1, lang, at].astype(np.int64), after[at]
        changed_lang, changed_at = [], []
        for step in range(BLOCK):
            state, ends[step, lang, at] = model.step(lang, state, grid[step, at])
            other = states[step, lang, at] != state
            states[step, lang, at] = state
            closed = other & (sizes[at] == step + 1)
            changed_lang.append(lang[closed])
            changed_at.append(at[closed])
            other &= ~closed
            lang, at, state = lang[other], at[other], state[other]
            if not len(at):
                break
        lang, at = np.concatenate(changed_lang), np.concatenate(changed_at)
        lang, at = lang[after[at] >= 0], at[after[at] >= 0]
    totals = np.zeros((len(model.langs), len(coded)))
    for row, ended in zip(totals, ends.sum(axis=0), strict=True):
        np.add.at(row, np.array(of)[order], ended if whole else ended + 1)
    return totals + whole


def _coded(text: str | None, symbols: np.ndarray) -> np.ndarray:
    """A text's symbols, runs of others than letters as one space, none at its ends."""
    codes = symbols[np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)]
    letter = codes >= 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, 0)[keep]
    return codes[:-1] if len(codes) and not codes[-1] else codes


def predict(model: Model, texts: list[str | None], whole: bool = False) -> pd.DataFrame:
    """lang_pred and score (0 to 1: by how much of the second's entropy the best is ahead) of each text.

    Phrases end with their blocks unless texts are parsed ``whole``, as ``identify`` does.
    """
    import pandas as pd  # not in the workers, which it would take memory from

    return pd.DataFrame(dict(zip(("lang_pred", "score"), predicted(model, texts, whole), strict=True)))


def predicted(model: Model, texts: list[str | None], whole: bool = False) -> tuple[list[str], list[float]]:
    """The columns of ``predict``."""
    symbols = _symbols(model.letters)
    langs, scores = [], []
    at = 0
    while at < len(texts):
        coded, n = [], 0
        while at < len(texts) and (not coded or n * max(len(model.langs), 1) < SLICE):
            coded.append(_coded(texts[at], symbols))
            n += -(-len(coded[-1]) // BLOCK) * BLOCK
            at += 1
        if not model.langs or not n:
            langs += ["und"] * len(coded)
            scores += [0.0] * len(coded)
            continue
        sizes = np.array([len(c) for c in coded])
        entropy = _parse(model, coded, whole) * np.array(model.logs)[:, None] / np.maximum(sizes, 1)
        best = entropy.argmin(axis=0)
        ranked = np.sort(entropy, axis=0)
        ahead = 1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(model.langs) > 1 else np.ones(len(coded))
        langs += [model.langs[b] if s else "und" for b, s in zip(best, sizes, strict=True)]
        scores += [float(min(max(a, 0.0), 1.0)) if s else 0.0 for a, s in zip(ahead, sizes, strict=True)]
    return langs, scores


def held_out(doc_id):
    """Documents kept from the fit: crc32 of the id as text leaves 2 by 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fit on a bounded sample of the rows (text, lang) whose both columns are set."""
    rows = labelled.filter("text is not null and lang is not null").select("lang", "text", F.xxhash64("text").alias("hash"))
    least = rows.groupBy("lang", F.pmod("hash", F.lit(sample_docs)).alias("class")).agg(F.min("hash").alias("hash"))
    # At most sample_docs rows a language.
    chosen = rows.join(F.broadcast(least.select("lang", "hash")), ["lang", "hash"]).withColumn("text", F.substring("text", 1, sample_chars))
    found: dict[str, list[str]] = {}
    for r in sorted(chosen.distinct().collect(), key=lambda r: (r["lang"], r["hash"], r["text"])):
        if t := normalised(r["text"]):
            found.setdefault(r["lang"], []).append(t)
    texts = {}
    for lang, own in found.items():
        # Short texts whole; what they leave is shared by the longer ones.
        left = sample_chars
        for i, t in enumerate(sorted(own, key=len)):
            part = t[: left // (len(own) - i)]
            left -= len(part)
            texts.setdefault(lang, []).append(part)
    return Model(texts)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score, which take the place of columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            langs, scores = predicted(shared.value, t.to_pylist(), whole=True)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # The rows stand in a struct, so that no name of theirs meets one of the work beside them.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = docs.select(row, run(F.col(f"`{text_col}`")).alias("found"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return found.select(*kept, F.col("found.lang_pred").alias("lang_pred"), F.col("found.score").alias("score"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model).drop("text")
