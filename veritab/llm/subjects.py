"""Subject areas of documents by class-association rules.

Fit (on at most ``max_labelled`` labelled documents, chosen by a hash of their id):

1. *Topic words*: words whose documents carry some label far more often than usual (lift and chi-squared).
2. *Rules*: the topic words of a whole sentence and the labels of its document are a transaction.  Parallel FP-growth
   (``frequent_sets``) finds the frequent sets of up to three words with their counts for each label, and each set with one label gives
   a rule ``words -> subject``.  A rule is pruned unless it is significant and more confident than every more general one.
   Sentences that versions of one docket repeat count once.
3. *Blocking rules*: sentences whose best rule names a subject the document lacks are failures.  FP-growth over the
   other words of those sentences finds frames ("counsel's comparison with ...") under which evidence fails.
4. *Calibration*: a logistic regression per feature set turns a document's evidence for a subject into a probability.

Scoring is one scan without a shuffle: each document is cut into sentences, every matching rule is applied, sentences under
a blocking rule don't count.  Subjects of probability >= ``threshold`` are given, and the most probable one at least.

Defined results: null, empty or blank texts get no subject; identical texts get the same subjects; extra columns are
ignored; without any labelled document the result is empty.
"""

from __future__ import annotations

import json
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.text import join_lines, token_words
from veritab.shared import ensure_checkpoint_dir

#: Words of a rule or frame at most, and the shards of the search for frequent sets.
MOST, SHARDS = 3, 64
#: A line that opens with the number of a paragraph.
PARAGRAPH = re.compile(r"\n\s*(?:¶ ?\d{1,3}|\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}(?:\.| -|  ))(?= )")


def _tokens(text: str) -> list[str]:
    return PARAGRAPH.sub(" ! ", join_lines(text)).split()


def cut(text: str) -> list[list[str]]:
    """Sentences as lists of words of three letters or more without digits; a numbered paragraph starts a new one."""
    out, now = [], []
    for token in _tokens(text):
        own, ends = _TOKENS[token]
        now.extend(own)
        if ends and now:
            out.append(now)
            now = []
    return out + [now] if now else out


class _Tokens(dict):
    LIMIT = 1_000_000

    def __missing__(self, token: str) -> tuple[tuple[str, ...], bool]:
        if len(self) >= self.LIMIT:
            self.clear()
        all_words = token_words(token)
        own = tuple(w for w in all_words if len(w) > 2 and w.isalpha())
        core = token.rstrip("\"'”’»)")
        ends = core[-1:] in (".", "!", "?", ";", ":") and len(core) > 4 and core[-2].isalpha() or core[-1:] in ("!", "?")
        self[token] = value = (own, bool(ends))
        return value


_TOKENS = _Tokens()


class _Relevant(dict):
    """What a token contributes to scoring: its words that some rule or frame has, and whether a sentence ends; None if neither."""

    def __init__(self, words: set[str]):
        super().__init__()
        self.words = words

    def __missing__(self, token: str):
        if len(self) >= _Tokens.LIMIT:
            self.clear()
        own, ends = _TOKENS[token]
        own = tuple(w for w in own if w in self.words)
        self[token] = value = (own, ends) if own or ends else None
        return value


@dataclass
class Model:
    """What scoring needs; its size is bounded by the labelled sample, not by the corpus."""

    subjects: list[str]
    rules: dict[frozenset[str], dict[int, float]] = field(default_factory=dict)  # words -> subject index -> log odds
    blocks: set[frozenset[str]] = field(default_factory=set)
    weights: np.ndarray | None = None  # logistic regression over features()
    threshold: float = 0.5

    def __post_init__(self) -> None:
        self.index()

    def index(self) -> None:
        self.topic = {w for r in self.rules for w in r}
        self.longest = max(map(len, self.rules), default=0)
        self.by_word: dict[str, list[tuple[frozenset[str], dict[int, float]]]] = defaultdict(list)
        for r, of in self.rules.items():
            self.by_word[min(r)].append((r, of))
        self.block_words = {w for b in self.blocks for w in b}
        self.relevant = _Relevant(self.topic | self.block_words)

    def cut(self, text: str) -> list[list[str]]:
        """The sentences with the words that scoring looks at; sentences without any are left out."""
        out, now = [], []
        for own, ends in filter(None, map(self.relevant.__getitem__, _tokens(text))):
            now.extend(own)
            if ends and now:
                out.append(now)
                now = []
        return out + [now] if now else out

    def save(self, path: str) -> None:
        """The model as JSON, to score later documents without fitting again."""
        rules = [[sorted(r), {str(k): v for k, v in of.items()}] for r, of in self.rules.items()]
        weights = None if self.weights is None else self.weights.tolist()
        with open(path, "w") as f:
            json.dump({"subjects": self.subjects, "rules": rules, "blocks": [sorted(b) for b in self.blocks], "weights": weights, "threshold": self.threshold}, f)

    @classmethod
    def load(cls, path: str) -> Model:
        with open(path) as f:
            d = json.load(f)
        rules = {frozenset(r): {int(k): v for k, v in of.items()} for r, of in d["rules"]}
        return cls(d["subjects"], rules, {frozenset(b) for b in d["blocks"]}, None if d["weights"] is None else np.array(d["weights"]), d["threshold"])

    def evidence(self, words: list[str]) -> dict[int, float]:
        """Subject index -> the strongest matching rule's log odds."""
        own = self.topic.intersection(words)
        best: dict[int, float] = {}
        for w in own:
            for r, of in self.by_word.get(w, ()):
                if len(r) == 1 or r <= own:
                    for s, v in of.items():
                        if v > best.get(s, -9.0):
                            best[s] = v
        return best

    def blocked(self, words: list[str]) -> bool:
        own = self.block_words.intersection(words)
        return bool(own) and any(b <= own for b in self.blocks)

    def features(self, sentences: list[list[str]]) -> np.ndarray:
        """For each subject: best evidence, sum over sentences, sentences led by it, its share of those, blocked ones."""
        k = len(self.subjects)
        x = np.zeros((k, 5))
        for words in sentences:
            found = self.evidence(words)
            if not found:
                continue
            lead = max(found, key=lambda s: (found[s], -s))
            if self.blocks and self.blocked(words):
                x[lead, 4] += 1
                continue
            for s, v in found.items():
                if v > 0:
                    x[s, 0] = max(x[s, 0], v)
                    x[s, 1] += v
            if found[lead] > 0:
                x[lead, 2] += 1
        total = x[:, 2].sum()
        if total:
            x[:, 3] = x[:, 2] / total
        x[:, 1], x[:, 2] = np.log1p(x[:, 1]), np.log1p(x[:, 2])
        return x

    def probabilities(self, sentences: list[list[str]]) -> np.ndarray:
        x = self.features(sentences)
        return 1 / (1 + np.exp(-(np.c_[np.ones(len(x)), x] @ self.weights)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method; deterministic."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * np.r_[0, w[1:]]
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def frequent_sets(transactions: DataFrame, least: int, most: int = MOST) -> dict[frozenset[str], tuple[int, dict[str, int]]]:
    """Sets of up to ``most`` words that some mark goes with ``least`` times: the set's transactions, and those of each such mark.

    Parallel FP-growth: words are ranked by their transactions; a transaction goes to the shard of each of its words as the more frequent
    words before it, and a shard grows the sets whose rarest word is its own, from conditional bases in which equal transactions
    are one.  ``transactions`` has (words array<string>, marks array<string>).
    """
    equal = transactions.groupBy("words", "marks").agg(F.count("*").alias("n")).checkpoint()
    counts = equal.select(F.explode("words").alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    ranked = [r["w"] for r in counts.orderBy(F.desc("n"), "w").toLocalIterator()]
    marks = sorted(r["m"] for r in equal.select(F.explode("marks").alias("m")).distinct().collect())
    if not ranked or not marks:
        return {}
    rank, place = {w: i for i, w in enumerate(ranked)}, {m: i for i, m in enumerate(marks)}

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for words, own, n in zip(pdf["words"], pdf["marks"], pdf["n"]):
                items = sorted(rank[w] for w in words if w in rank)
                where = {item % SHARDS: k for k, item in enumerate(items)}  # the rarest word of each shard
                out += [(shard, items[: k + 1], [place[m] for m in own], n) for shard, k in where.items()]
            yield pd.DataFrame(out, columns=["shard", "items", "marks", "n"])

    def mine(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, base = int(pdf["shard"].iloc[0]), Counter()
        # all counts of a set are one integer: its transactions in the lowest 40 bits, each mark's in the next ones
        for items, own, n in zip(pdf["items"], pdf["marks"], pdf["n"]):
            base[tuple(items)] += int(n) * (1 + sum(1 << 40 * (int(m) + 1) for m in own))
        field = (1 << 40) - 1
        out: list[tuple] = []

        def grow(conditional: dict, suffix: tuple) -> None:
            found: Counter = Counter()
            for items, n in conditional.items():
                for x in items:
                    if suffix or x % SHARDS == shard:
                        found[x] += n
            for x, n in found.items():
                of = [(m, c) for m in range(len(marks)) if (c := n >> 40 * (m + 1) & field) >= least]
                if not of:  # no larger set can have more
                    continue
                own = (x, *suffix)
                out.append((list(own), n & field, [m for m, _ in of], [c for _, c in of]))
                if len(own) < most:
                    narrower: Counter = Counter()
                    for items, k in conditional.items():
                        at = bisect_left(items, x)
                        if at and at < len(items) and items[at] == x:
                            narrower[items[:at]] += k
                    if narrower:
                        grow(narrower, own)

        grow(base, ())
        return pd.DataFrame(out, columns=["items", "n", "marks", "of"])

    shards = equal.mapInPandas(spread, "shard int, items array<int>, marks array<int>, n long")
    found = shards.groupBy("shard").applyInPandas(mine, "items array<int>, n long, marks array<int>, of array<long>")
    return {frozenset(ranked[i] for i in r["items"]): (r["n"], {marks[m]: c for m, c in zip(r["marks"], r["of"])}) for r in found.toLocalIterator()}


def fit(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = "docket_no",
    subject_col: str = "subject", max_labelled: int = 20_000, min_docs: int | None = None, threshold: float = 0.5,
) -> Model:
    """The model; texts, sentences and transactions stay with the executors, only counts and rules reach the driver.

    A word needs ``min_docs`` dockets, by default one in 500 labelled documents and 3 at least: a party's name in a few dockets tells no subject.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    own = labels.where(F.col(subject_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_set(subject_col)).alias("labels"))
    group = F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")
    grp = F.coalesce(group, F.concat(F.lit("#"), F.col(id_col).cast("string")))
    docs = documents.select(F.col(id_col).alias("id"), grp.alias("grp"), F.col(text_col).alias("text")).where(F.length(F.trim("text")) > 0)
    ids = docs.select("id").join(own, "id").select("id", "labels").orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    # at most max_labelled ids, so the texts of the corpus need no shuffle
    rows = docs.join(F.broadcast(ids), "id").mapInPandas(_cut_rows, "grp string, labels array<string>, cut string").checkpoint()
    subjects = [r["s"] for r in rows.select(F.explode("labels").alias("s")).distinct().orderBy("s").collect()]
    model = Model(subjects, threshold=threshold)
    if not subjects:
        return model
    if min_docs is None:
        min_docs = max(3, rows.count() // 500)
    index = {s: k for k, s in enumerate(subjects)}
    _topic_rules(model, rows, index, min_docs)
    _blocking_rules(model, rows, index)
    _calibrate(model, rows)
    return model


def _cut_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cuts = ["\n".join(" ".join(s) for s in cut(t)) for t in pdf["text"]]
        yield pd.DataFrame({"grp": pdf["grp"], "labels": pdf["labels"], "cut": cuts}, dtype=object)


def _sentences(text: str) -> list[list[str]]:
    return [s.split(" ") for s in text.split("\n")] if text else []


def _topic_words(rows: DataFrame, min_docs: int) -> set[str]:
    """Words that some label goes with; versions of one docket count once."""
    words = rows.select("grp", F.explode(F.array_distinct(F.split("cut", "[ \n]"))).alias("w")).where(F.length("w") > 0).distinct()
    labels = rows.select("grp", F.explode("labels").alias("s")).distinct()
    n = rows.select("grp").distinct().count()
    n_s = labels.groupBy("s").agg(F.count("*").alias("n_s"))
    n_w = words.groupBy("w").agg(F.count("*").alias("n_w")).where(F.col("n_w") >= min_docs)
    both = words.join(n_w.select("w"), "w", "left_semi").join(labels, "grp").groupBy("w", "s").agg(F.count("*").alias("both")).where(F.col("both") >= min_docs)
    prior = F.col("n_s") / n
    expected = F.col("n_w") * prior
    chi = F.try_divide((F.col("both") - expected) ** 2, expected * (1 - prior))
    found = both.join(n_w, "w").join(n_s, "s").where((F.col("n_s") < n) & (F.col("both") / F.col("n_w") >= 1.8 * prior) & (chi >= 12))
    return {r["w"] for r in found.select("w").distinct().collect()}


def _topic_rules(model: Model, rows: DataFrame, index: dict[str, int], min_docs: int) -> None:
    topic = _topic_words(rows, min_docs)

    def transactions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {
                (grp, tuple(sorted(items)), tuple(own))
                for grp, own, text in zip(pdf["grp"], pdf["labels"], pdf["cut"]) for words in _sentences(text) if (items := topic.intersection(words))
            }
            yield pd.DataFrame([(g, list(i), list(m)) for g, i, m in out], columns=["grp", "words", "marks"], dtype=object)

    data = rows.mapInPandas(transactions, "grp string, words array<string>, marks array<string>").distinct().checkpoint()
    count = data.count()
    if not count:
        return
    marks = {r["m"]: r["count"] for r in data.select(F.explode("marks").alias("m")).groupBy("m").count().collect()}
    prior = np.clip(np.array([marks.get(s, 0) for s in model.subjects]) / count, 1e-3, 1 - 1e-3)
    conf: dict[frozenset[str], dict[int, tuple[float, int]]] = defaultdict(dict)
    for words, (of, by) in frequent_sets(data, max(min_docs, rows.count() // 2000)).items():
        for mark, n in by.items():
            s = index[mark]
            p = (n + 2 * prior[s]) / (of + 2)
            conf[words][s] = (math.log(p / (1 - p)) - math.log(prior[s] / (1 - prior[s])), of)
    for words, of in conf.items():
        kept = {}
        for s, (v, n) in of.items():
            general = [conf[words - {w}][s][0] for w in words if len(words) > 1 and s in conf.get(words - {w}, {})]
            if abs(v) > 0.7 and n >= min_docs and all(v > g + 0.3 for g in general):
                kept[s] = v
        if kept and max(kept.values()) > 1.0:
            model.rules[words] = kept
    model.index()


def _blocking_rules(model: Model, rows: DataFrame, index: dict[str, int]) -> None:
    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for grp, own, text in zip(pdf["grp"], pdf["labels"], pdf["cut"]):
                right = {index[s] for s in own}
                for words in _sentences(text):
                    found = model.evidence(words)
                    if not found:
                        continue
                    lead = max(found, key=lambda s: (found[s], -s))
                    if found[lead] >= 1.5:
                        out.add((grp, " ".join(sorted(set(words) - model.topic)), lead, lead not in right))
            yield pd.DataFrame(list(out), columns=["grp", "rest", "lead", "bad"])

    found = rows.mapInPandas(outcomes, "grp string, rest string, lead int, bad boolean")
    found = found.groupBy("grp", "rest", "lead").agg(F.bool_and("bad").alias("bad")).checkpoint()
    base = found.agg(F.avg(F.col("bad").cast("double")).alias("b")).first()["b"]
    if base is None:
        return
    limit = max(0.5, min(0.9, 2.5 * base))
    words = found.select(F.explode(F.split("rest", " ")).alias("w"), "bad").where(F.length("w") > 0)
    counts = words.groupBy("w").agg(F.count_if("bad").alias("bad"), F.count("*").alias("all"))
    counts = counts.where((F.col("bad") >= 4) & (F.col("bad") / F.col("all") >= max(0.35, 1.8 * base)))
    order = {r["w"] for r in counts.collect()}

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(items, ["bad"] if bad else []) for rest, bad in zip(pdf["rest"], pdf["bad"]) if (items := sorted(order.intersection(rest.split(" "))))]
            yield pd.DataFrame(out, columns=["words", "marks"], dtype=object)

    rules = {}
    for frame, (of, by) in frequent_sets(found.select("rest", "bad").mapInPandas(frames, "words array<string>, marks array<string>"), 6).items():
        share = by["bad"] / of
        if share - 1.3 * math.sqrt(share * (1 - share) / of) >= limit:
            rules[frame] = share
    model.blocks = {w for w in rules if not any(w - {x} in rules for x in w if len(w) > 1)}
    model.index()


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Logistic regression on the features of the labelled sample, which come as one block of numbers for each batch."""

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [np.c_[model.features(_sentences(t)), [s in own for s in model.subjects]] for own, t in zip(pdf["labels"], pdf["cut"])]
            yield pd.DataFrame({"block": [np.concatenate(out).tobytes()] if out else []}, dtype=object)

    blocks = [np.frombuffer(r["block"]).reshape(-1, 6) for r in rows.mapInPandas(features, "block binary").collect()]
    x = np.concatenate(blocks)
    x = x[np.lexsort(x.T)]  # the order of additions must not depend on the order of blocks
    model.weights = _logistic(x[:, :5], x[:, 5])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, subject, probability): the subjects of every document with text."""
    schema = "doc_id long, subject string, probability double"
    if model.weights is None:
        return documents.sparkSession.createDataFrame([], schema)
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if not text.strip():
                    continue
                p = model.probabilities(model.cut(text))
                chosen = np.flatnonzero(p >= model.threshold)
                for s in chosen if len(chosen) else [int(p.argmax())]:
                    out.append((doc, model.subjects[s], float(p[s])))
            yield pd.DataFrame(out, columns=["doc_id", "subject", "probability"])

    return docs.mapInPandas(run, schema)
