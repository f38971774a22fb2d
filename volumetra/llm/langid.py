"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a sample of its labelled text is built.
A text is parsed against it greedily: each phrase is the longest match from its
place on (one character where nothing matches). The language whose phrases,
times the bits that name a place in its sample, are fewest per character wins.

* Text is lower-cased; a run of other characters than letters is one space.
* It is parsed in segments of SEGMENT characters, so that a very long text
  costs as much memory as a short one; a phrase ends with its segment.
* The sample: per language at most SAMPLE_DOCS documents on average, picked by
  a hash of doc_id, and `sample_chars` letters of them, or fewer where the
  automata would take more than TABLE_MB. Everything else covers all rows.

A null text and a text without a letter is `und` with score 0, and so is every
text where nothing is labelled. Ties go to the first language by name. The
score is 1 - best / second, or 1 with a single language.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volumetra.llm.common import batches, ship

SEGMENT = 512
SAMPLE_DOCS = 64
SAMPLE_CHARS = 48_000
TABLE_MB = 96
ALPHABET = 250
SPACE, UNKNOWN, PAD = 0, 1, 2


def normal(text: str) -> str:
    """Lower case; every run of characters that are no letters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


class Automaton:
    """Suffix automaton with a dense transition table; state 0 is the root, and 0 in the table is no transition."""

    def __init__(self, symbols: np.ndarray, classes: int):
        link, length, moves = [-1], [0], [{}]
        last = 0
        for c in symbols.tolist():
            cur = len(moves)
            length.append(length[last] + 1)
            link.append(0)
            moves.append({})
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(moves)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    moves.append(dict(moves[q]))
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.classes = classes
        table = np.zeros((len(moves), classes), np.int32)
        for s, m in enumerate(moves):
            if m:
                table[s, list(m)] = list(m.values())
        self.flat, self.root = table.reshape(-1), table[0].copy()

    def phrases(self, lanes: np.ndarray) -> np.ndarray:
        """Phrases of each lane; lanes is (steps x n) of symbols, PAD at the ends."""
        state = np.zeros(lanes.shape[1], np.int32)
        count = np.zeros(lanes.shape[1], np.int32)
        classes = np.int32(self.classes)
        for c in lanes:
            to = self.flat[state * classes + c]
            none = to == 0
            count += (none | (state == 0)) & (c != PAD)
            state = np.where(none, self.root[c], to)
        return count


class Model:
    def __init__(self, samples: dict[str, str]):
        self.names = sorted(samples)
        letters = Counter()
        for n in self.names:
            letters.update(samples[n])
        letters.pop(" ", None)
        self.alphabet = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))[:ALPHABET]]
        symbol = np.full(0x110000, SPACE, np.uint8)
        symbol[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = UNKNOWN
        symbol[[ord(c) for c in self.alphabet]] = np.arange(3, 3 + len(self.alphabet))
        self.symbol = symbol
        classes = 3 + len(self.alphabet)
        room = int(TABLE_MB * 1e6 / (8 * classes * max(1, len(self.names))))
        self.automata = []
        self.bits = []
        for n in self.names:
            s = self.symbols(samples[n])[:room]
            self.automata.append(Automaton(s, classes))
            self.bits.append(np.log2(max(2, len(s))))

    def symbols(self, text: str) -> np.ndarray:
        s = self.symbol[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        blank = s == SPACE
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        return s[keep]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [self.symbols(t) if t else np.zeros(0, np.uint8) for t in texts]
        sizes = np.array([-(-len(s) // SEGMENT) for s in found], np.int64)
        flat = np.full(int(sizes.sum()) * SEGMENT, PAD, np.uint8)
        at = 0
        for s, n in zip(found, sizes):
            flat[at : at + len(s)] = s
            at += int(n) * SEGMENT
        lanes = np.ascontiguousarray(flat.reshape(-1, SEGMENT).T).astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), sizes)
        cost = np.stack([np.bincount(owner, a.phrases(lanes), len(texts)) * b for a, b in zip(self.automata, self.bits)]) if self.names else np.zeros((0, len(texts)))
        names, scores = [], []
        for i, s in enumerate(found):
            if not self.names or not (s != SPACE).any():
                names.append("und")
                scores.append(0.0)
                continue
            order = np.argsort(cost[:, i], kind="stable")
            names.append(self.names[order[0]])
            scores.append(1.0 if len(order) == 1 else float(1 - cost[order[0], i] / cost[order[1], i]))
        return names, scores


_MODELS: dict[str, Model] = {}


def model_of(samples: dict[str, str]) -> Model:
    """One model for each worker process."""
    key = hashlib.sha256(repr(sorted(samples.items())).encode()).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(samples)
    return _MODELS[key]


def draw_samples(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Per language a bounded sample of labelled (doc_id, text, lang), by the hash order of doc_id."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return {}
    # the share of all 64-bit hashes that gives sample_docs documents, however many there are
    last = {k: min((1 << 63) - 1, int(sample_docs / n * 2**64) - (1 << 63)) for k, n in counts.items()}
    limit = F.element_at(F.create_map(*[x for k, v in last.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.col("lang"))
    drawn = rows.withColumn("mark", F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))).filter(F.col("mark") <= limit)
    out: dict[str, str] = {}
    for r in sorted(drawn.select("lang", "mark", F.substring("text", 1, sample_chars).alias("text")).collect(), key=lambda r: (r["lang"], r["mark"], r["text"])):
        if len(out.get(r["lang"], "")) < sample_chars:
            out[r["lang"]] = (out.get(r["lang"], "") + " " + normal(r["text"]))[:sample_chars]
    return out


def identify(docs: DataFrame, samples: dict[str, str], text: str = "text") -> DataFrame:
    """docs without text, with lang_pred and score."""
    ship(docs.sparkSession)
    rest = [f for f in docs.schema if f.name not in (text, "lang_pred", "score")]
    names = [f.name for f in rest]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["lang_pred string", "score double"])

    def run(frames):
        model = model_of(samples)
        for batch in batches(frames, 4.0, text):
            lang, score = model.predict(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def cross_parse(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out."""
    learn = docs.filter(~F.coalesce(held_out(), F.lit(False)))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return identify(rows, draw_samples(learn.select("doc_id", "text", "lang")))
