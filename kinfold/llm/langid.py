"""Language identification by cross-parsing.

A suffix automaton per language holds the commonest distinct words of a sample of its labelled
documents. A new text is parsed greedily into the longest phrases each automaton contains; the
language that needs the fewest phrases for the text's length is predicted. Words are parsed framed
by blanks and phrases end with them, so a word's phrases are counted once per worker and a text
costs one lookup per word.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.llm.common import col, small_batches

#: Labelled documents of a language that are learned from (about; chosen by a hash, read whole), the
#: letters its automaton is made of at most, and those of all automata together. A letter makes two
#: states at most, some 500 bytes in a worker.
SAMPLE_DOCS, SAMPLE_CHARS, TOTAL_CHARS = 400, 30_000, 600_000
#: Phrase counts (words times languages) a worker keeps, and the longest word kept.
CELLS, WORD_CHARS = 3_200_000, 64
#: Distinct words of the sample a task holds before it passes their counts on.
HELD = 300_000
_words = re.compile(r"[^\W\d_]+").findall


def normalise(text: str) -> list[str]:
    """The text's words: runs of letters (Unicode category L), lower case."""
    own = _words(text.lower())
    if not "".join(own).isalpha():  # numerals such as a half or a superscript are in no category of digits
        own = [w for run in own for w in "".join(c if c.isalpha() else " " for c in run).split()]
    return own


class Automaton:
    """Suffix automaton of a text; a state is a dict from a letter to the next state's dict."""

    def __init__(self, text: str):
        nxt, link, length = [{}], [-1], [0]
        last = 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        for state in nxt:
            for c, to in state.items():
                state[c] = nxt[to]
        self.root = nxt[0]

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse; a letter the sample lacks is a phrase of its own."""
        root = state = self.root
        n = 1
        for c in text:
            to = state.get(c)
            if to is None:
                n += 1
                to = root.get(c, root)
            state = to
        return n


class Parser:
    """Automata of all languages, and the phrase counts of the words met so far."""

    def __init__(self, sample: dict[str, str]):
        self.names = sorted(sample)
        # Phrases lie within words, so each distinct word of a sample is needed once.
        self.room = max(1, CELLS // max(1, len(self.names)))
        self.automata = [Automaton(" " + " ".join(dict.fromkeys(normalise(sample[k]))) + " ") for k in self.names]
        self.index: dict[str, int] = {}
        self.table = np.zeros((self.room, len(self.names)), np.int32)

    def count(self, word: str) -> list[int]:
        framed = f" {word} "
        return [a.phrases(framed) for a in self.automata]

    def phrases(self, own: list[str]) -> np.ndarray:
        """Phrases of the words under each language."""
        index, table = self.index, self.table
        got = list(map(index.get, own))
        total = np.zeros(len(self.names), np.int64)
        if None in got:
            new = [w for w in set(own).difference(index) if len(w) <= WORD_CHARS]
            if len(index) + len(new) > self.room:
                index.clear()
                new = [w for w in set(own) if len(w) <= WORD_CHARS][: self.room]
            for w in new:
                table[len(index)] = self.count(w)
                index[w] = len(index)
            got = []
            for w, n in zip(own, map(index.get, own)):
                if n is None:
                    total += self.count(w)
                else:
                    got.append(n)
        return total + table[np.array(got, np.int64)].sum(axis=0, dtype=np.int64)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """The words each language's automaton is made of, for :func:`predict`.

    Per language about ``sample_docs`` rows are read whole, chosen by a hash of id and text; their
    words are counted where they are read, and the commonest (then the first by letters) make up
    ``sample_chars`` letters, less where there are over twenty languages (``TOTAL_CHARS``). Only these
    reach the driver. Repeated rows are chosen together, and rows without id by their text.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}"))
    rank = F.pmod(F.xxhash64(col(id_col).cast("string"), col(text_col)), F.lit(1 << 20))
    rows = rows.select(col(lang_col).cast("string").alias("lang"), rank.alias("rank"), col(text_col).alias("text"))
    sizes = rows.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.lit(sample_docs << 20) / F.count("*"))).alias("share"))
    chosen = rows.join(F.broadcast(sizes), "lang").where("rank < share").select("lang", "text")

    def count(batches):
        held: Counter = Counter()

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.string()), pa.array([w for _, w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()
            return made

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update((lang, w) for w in normalise(text) if len(w) <= WORD_CHARS)
                if len(held) > HELD:
                    yield flush()
        yield flush()

    words = chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    best = words.select("lang", "word", F.row_number().over(order).alias("at"), F.sum(F.length("word") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("chars")).where(F.col("chars") <= sample_chars)
    sample: dict[str, list] = {}
    for r in best.orderBy("lang", "at").toArrow().to_pylist():
        sample.setdefault(r["lang"], []).append(r["word"])
    share = min(sample_chars, TOTAL_CHARS // max(1, len(sample)))
    return {k: " ".join(v)[:share] for k, v in sample.items()}


_made: dict[int, tuple[dict, Parser]] = {}


def parser(sample: dict[str, str]) -> Parser:
    """The parser of a sample, built once per Python worker."""
    key = hash(tuple(sorted(sample.items())))
    if key not in _made or _made[key][0] != sample:
        _made.clear()
        _made[key] = (sample, Parser(sample))
    return _made[key][1]


def score_text(text: str | None, models: Parser) -> tuple[str, float]:
    own = normalise(text) if text else []
    if not own or not models.names:
        return "und", 0.0
    size = sum(map(len, own)) + len(own)
    rates = models.phrases(own) / size
    best = int(np.argmin(rates))  # of equals, the first by name
    # Cost of a text of this length under each language, as a share: how far the best one leads.
    lead = (rates[best] - rates) * min(size, 400)
    return models.names[best], float(1.0 / np.exp(np.maximum(lead, -700.0)).sum())


def predict(docs: DataFrame, sample: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, lang_pred, score``.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Ties go
    to the first language by name. Null ids and repeated rows pass through; an empty table gives
    no row.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches):
        models = parser(shared.value)
        for batch in batches:
            got = [score_text(t, models) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
