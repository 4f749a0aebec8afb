"""Toxicity by a lexicon trie met with Levenshtein automata, and context windows around the matches.

The lexicon is learned from labelled words and stems. A word of a text that is no term walks the trie together
with the states of its Levenshtein automaton (the row of edit distances to the trie's prefix) and is a
misspelled term if an end is reached within the allowed distance. Windows of words around the matches tell
abuse (other matches near by, the reader addressed) from quotation (quote marks, verbs of saying), and a
logistic model over these scores gives the probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary_texts, on_workers
from .quality import remainder, training_rows

#: Terms used where there are no labels to learn from.
SEED_TERMS = ("idiot", "moron", "scum", "loser", "pathetic", "worthless", "stupid", "trash", "clown", "disgusting")
#: Verbs of saying, and words that address the reader, in four languages.
SAYING = frozenset("said says wrote quoted called quote dijo escribió citó llamó sagte schrieb zitierte nannte dit écrit cité appelé".split())
ADDRESS = frozenset("you your you're u tú tu usted eres du dein ihr bist sie tu vous votre es êtes".split())
QUOTES = frozenset("\"'“”„«»‘’")

#: Digits and signs that stand for letters.
_LEET = str.maketrans("013457@$!", "oieastasi")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
_LONG_RUN = re.compile(r"(.)\1{2,}")
_INNER = re.compile(r"[\W_]+")
STEMS = (4, 5)
SHORTEST = 3  # letters of a term
NEAR, WIDE = 8, 20
FEATURES = ("exact", "misspelled", "stems", "abusive", "quoted", "per_100", "densest", "addressed", "any")
_CACHE_WORDS = 200_000


def plain(word: str) -> str:
    """A word as it is looked up: lower case, letters for look-alikes, no signs around it, no long runs."""
    word = word.lower()
    if not word.isalpha():
        word = _TRIM.sub("", word)
        if not word.isalpha():
            word = _TRIM.sub("", word.translate(_LEET))
    return _LONG_RUN.sub(r"\1\1", word)


class Lexicon:
    """Terms (whole words) and stems (beginnings of words) with the trie of the terms."""

    def __init__(self, terms, stems=()):
        self.terms, self.stems = frozenset(terms), frozenset(stems)
        self.trie: dict = {}
        for term in self.terms:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
        self.cuts = {cut for t in self.terms if self.allowed(t) for cut in _cuts(t)}
        # A word within one edit of a term has one half of it whole, at its own beginning or end.
        halves = [(t[: len(t) // 2], t[len(t) // 2 :]) for t in self.terms if self.allowed(t)]
        self.heads, self.tails = (sorted({len(h): {x for x in part if len(x) == len(h)} for h in part}.items()) for part in ({a for a, _ in halves}, {b for _, b in halves}))
        self.longest = max(map(len, self.terms), default=0) + 1
        self.seen: dict[str, int] = {}
        self.hits: set[str] = set()

    @staticmethod
    def allowed(term: str) -> int:
        """Edits that still count as the term."""
        return 1 if len(term) >= 5 else 0

    def kind(self, word: str) -> int:
        """0 no match, 1 a term, 2 a misspelled term, 3 a stem. A word with signs inside is also looked up in parts."""
        found = self.look(plain(word))
        if not found and not word.isalpha() and len(parts := _INNER.split(_TRIM.sub("", word))) > 1:
            kinds = {self.look(plain(x)) for x in set(parts)} - {0}
            found = next((k for k in (1, 3, 2) if k in kinds), 0)
        return found

    def look(self, w: str) -> int:
        if len(w) < SHORTEST:
            return 0
        if w in self.terms:
            return 1
        if any(w[:n] in self.stems for n in STEMS):
            return 3
        return 2 if len(w) <= self.longest and self.near(w) and self.walk(w) is not None else 0

    def near(self, w: str) -> bool:
        """False for words that no walk can match: more than one edit from every term, by its halves and by what is
        left of both after a letter is deleted."""
        for k, heads in self.heads:
            if w[:k] in heads:
                break
        else:
            for k, tails in self.tails:
                if w[-k:] in tails:
                    break
            else:
                return False
        return not self.cuts.isdisjoint(_cuts(w))

    def walk(self, word: str, limit: int = 1):
        """The trie met with the Levenshtein automaton of word: a term within limit edits, or None.

        A state is the row of edit distances between the trie's prefix and the word's beginnings; only those of about
        the prefix's length can be within the limit, so that is all that is kept: row[k] is that of length
        depth - limit + k."""
        n, wide, far = len(word), 2 * limit + 1, limit + 1
        start = [abs(k - limit) if 0 <= k - limit <= n else far for k in range(wide)]
        stack = [(self.trie, start, 0)]
        while stack:
            node, row, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    if 0 <= n - depth + limit < wide and row[n - depth + limit] <= min(limit, self.allowed(child)):
                        return child
                    continue
                after, left = [], far
                for k in range(wide):
                    i = depth + 1 - limit + k
                    if not 0 <= i <= n:
                        left = far
                    else:
                        left = min(left + 1, row[k + 1] + 1 if k + 1 < wide else far, row[k] + (word[i - 1] != c) if i else far)
                    after.append(left)
                if min(after) <= limit:
                    stack.append((child, after, depth + 1))
        return None

    def matched(self, words: list[str]) -> dict[str, int]:
        """The distinct words that match, with their kind; each word is looked up once."""
        distinct = set(words)
        if len(self.seen) > _CACHE_WORDS:
            self.seen.clear()
            self.hits.clear()
        for w in [w for w in distinct if w not in self.seen]:
            k = self.seen[w] = self.kind(w)
            if k:
                self.hits.add(w)
        return {w: self.seen[w] for w in distinct & self.hits}


def _all_words(text: str) -> set[str]:
    """The words between blanks, and the parts of those with signs inside."""
    words = set(text.split())
    return words | {x for w in words if not w.isalpha() for x in _INNER.split(w)}


def _cuts(word: str) -> set[str]:
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def context_scores(text: str, lexicon: Lexicon) -> list[float]:
    """FEATURES of a whole text."""
    words = text.split()
    found = lexicon.matched(words)
    if not found:
        return [0.0] * len(FEATURES)
    at = [(i, found[w]) for i, w in enumerate(words) if w in found]
    kinds = Counter(k for _, k in at)
    abusive = quoted = addressed = 0.0
    densest, first = 0, 0
    for j, (i, _) in enumerate(at):
        before, after = words[max(0, i - NEAR) : i], words[i + 1 : i + 1 + NEAR]
        marks = sum(w[0] in QUOTES for w in [*before, words[i]]) - sum(w[-1] in QUOTES for w in before)
        closes = words[i][-1] in QUOTES or any(w[-1] in QUOTES for w in after)
        said = any(plain(w) in SAYING for w in before)
        if (marks > 0 and closes) or said:
            quoted += 1
        else:
            abusive += 1
        addressed += any(plain(w) in ADDRESS for w in [*before, *after])
        while at[first][0] < i - WIDE:
            first += 1
        densest = max(densest, j - first + 1)
    return [
        math.log1p(kinds[1]), math.log1p(kinds[2]), math.log1p(kinds[3]), math.log1p(abusive), math.log1p(quoted),
        math.log1p(100 * len(at) / len(words)), float(densest), math.log1p(addressed), 1.0,
    ]


def label_words(batches):
    """text, label -> for each word and stem of the task's texts: texts with it, and those of label 1."""
    import pyarrow as pa

    total, toxic = Counter(), Counter()
    for batch in batches:
        for text, label in zip(binary_texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = {w for w in map(plain, _all_words(text.decode(errors="replace"))) if len(w) >= SHORTEST}
            entries = words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}
            total.update(entries)
            if label:
                toxic.update(entries)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64()), pa.array([toxic[w] for w in total], pa.int64())], ["entry", "n", "n_toxic"])


def learn_lexicon(known: DataFrame, toxic: int, share: float, least_texts: int, least_share: float) -> Lexicon:
    """Words and stems with share of their texts toxic, that appear in at least least_texts of the toxic texts and in
    least_share of them: the more texts, the more words are in toxic ones only by chance. As known is a bounded
    sample, so is the lexicon; none of these entries is left out."""
    least = max(least_texts, math.ceil(least_share * toxic))
    counted = known.select("text", "label").mapInArrow(on_workers(label_words), "entry string, n long, n_toxic long")
    summed = counted.groupBy("entry").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    rare = summed.filter((F.col("n_toxic") >= least) & (F.col("n_toxic") >= share * F.col("n")))
    entries = [r["entry"] for r in rare.select("entry").collect()]
    stems = {e[:-1] for e in entries if e[-1] == "*"}
    return Lexicon([e for e in entries if e[-1] != "*"] or SEED_TERMS, {s for s in stems if not any(s != t and s.startswith(t) for t in stems)})


def measure(batches, terms, stems):
    """doc_id, text, label -> doc_id, label, features."""
    import pyarrow as pa

    lexicon = Lexicon(terms, stems)
    for batch in batches:
        rows = [context_scores(t.decode(errors="replace"), lexicon) for t in binary_texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "features"])


def fit_logistic(x, y, rounds: int = 50, ridge: float = 1.0):
    """Weights (the last is the constant) by Newton's method."""
    import numpy as np

    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Weights where there are no labels of both classes: any abusive match counts.
DEFAULT_WEIGHTS = (1.0, 0.5, 0.5, 1.5, -2.0, 0.5, 0.2, 0.3, 0.5, -3.0)


def score(batches, terms, stems, weights, text_col, out):
    """Adds the score to the columns out."""
    import numpy as np
    import pyarrow as pa

    lexicon, w = Lexicon(terms, stems), np.array(weights)
    for batch in batches:
        texts = binary_texts(batch.column(text_col))
        x = np.array([context_scores(t.decode(errors="replace"), lexicon) for t in texts], float).reshape(len(texts), len(FEATURES))
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(p)], [*out, "score"])


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, held: int = 2, sample_rows: int = 20_000, threshold: float = 0.3, share: float = 0.8,
    least_texts: int = 4, least_share: float = 0.003, carry: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (probability of label 1), predicted (score >= threshold).

    With carry, all columns of docs come along; those named like a result are replaced.

    Lexicon and weights are learned from at most sample_rows labelled documents outside the held-out part
    (crc32(doc_id) mod parts = held); every document is scored, from its whole text alone. A term is a word of
    SHORTEST letters or more of which share of the texts are toxic; it must be in least_texts toxic texts and in
    least_share of them. Terms of five letters or more also match within one edit, and the first four or five
    letters of words can be terms (stems). A word between blanks counts once, whole or by its parts between signs.

    - null, empty or blank text: no match, the lowest score. null doc_id: scored, never learned.
    - null labels are not learned; several labels of one doc_id count as their maximum.
    - no labels, or one class only: the seed terms and default weights. Ill-formed UTF-8 is read with
      replacement characters.
    - repeated rows get equal scores. empty table: no rows. Further columns are ignored.
    """
    import numpy as np

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (remainder(parts, id_col) == held).alias("held_out"))
    chosen = training_rows(labels, label, parts, held, sample_rows)
    known = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    lexicon = learn_lexicon(known, chosen.agg(F.sum("label").alias("n")).first()["n"] or 0, share, least_texts, least_share)
    terms, stems = sorted(lexicon.terms), sorted(lexicon.stems)
    rows = known.mapInArrow(on_workers(measure, terms, stems), "doc_id long, label int, features array<double>").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    weights = list(DEFAULT_WEIGHTS)
    if len(y) and y.min() != y.max():
        order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
        x = np.array(rows.column("features").to_pylist(), float).reshape(len(y), len(FEATURES))
        weights = fit_logistic(x[order], y[order]).tolist()
    extra = [c for c in docs.columns if c not in ("doc_id", "held_out", "score", "predicted", id_col, text_col)] if carry else []
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), *extra, (remainder(parts, id_col) == held).alias("held_out"))
    out = [c for c in whole.columns if carry or c != text_col]
    schema = T.StructType([whole.schema[c] for c in out] + [T.StructField("score", T.DoubleType())])
    scored = whole.mapInArrow(on_workers(score, terms, stems, weights, text_col, out), schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
