"""Toxicity by a weighted finite-state pattern grammar.

Small transducers over token classes, composed into one machine:

* negation: an insult or threat within three tokens after a negation counts less;
* reported speech: after a verb of saying, it counts less;
* target: together with a person addressed or spoken of, it counts more.

A text is cut into clauses; a clause that holds an insult or threat runs
through the machine and gets the sum of its weights, so a matched clause is
scored, not a word by itself.  Insults are a fixed list plus words and word
stems learned from labelled training texts (log-odds of document counts).  A
logistic regression over a text's clause scores gives the probability.

Learning sees at most ``SAMPLE_ROWS`` labelled rows, by hash order; scoring
sees every whole text and no label, language, source or id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketflow.llm.common import let
from marketflow.session import materialize, ship_package

SAMPLE_ROWS = 20_000
MAX_LEARNED = 2_000
MIN_TEXTS, MIN_SHARE, MIN_TOXIC = 3, 0.01, 0.9
MIN_EVIDENCE = 22.0          # likelihood ratio statistic of a learned word against the base rate
STEMS = (4, 5, 6)

# Fixed word lists of the grammar.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "worthless", "pathetic", "disgusting",
           "imbecile", "fool", "bastard", "filth", "vermin", "coward", "liar", "dumb", "dimwit", "parasite"]
THREATS = ["kill", "murder", "strangle", "stab", "shoot", "lynch", "slaughter", "exterminate"]
TARGETS = ["you", "your", "yours", "he", "she", "they", "him", "her", "them", "his", "their", "people", "everyone",
           "du", "ihr", "euch", "dich", "sie", "tu", "vous", "toi", "elle", "usted", "ustedes", "ellos", "ella"]
NEGATIONS = ["not", "no", "never", "without", "neither", "nor", "nicht", "kein", "keine", "nie", "pas", "jamais",
             "sans", "nunca", "sin", "ni"]
REPORTS = ["said", "says", "wrote", "claimed", "reported", "quoted", "called", "alleged", "sagte", "schrieb", "dit",
           "dijo", "escribió"]


FIXED = {w: (name, 1.0) for name, listed in (("report", REPORTS), ("negation", NEGATIONS), ("target", TARGETS),
                                             ("threat", THREATS)) for w in listed}


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted: arcs map (state, label) to (state, label out, weight)."""
    arcs: dict
    start: int = 0

    def step(self, state, label):
        return self.arcs.get((state, label), (state, label, 1.0))


CLASSES = ("insult", "threat", "target", "negation", "report", "other")


def negation(reach: int = 3, weight: float = 0.3) -> Transducer:
    arcs = {}
    for s in range(reach + 1):
        for c in CLASSES:
            hit = c in ("insult", "threat") and s > 0
            arcs[s, c] = (reach if c == "negation" else max(s - 1, 0), c, weight if hit else 1.0)
    return Transducer(arcs)


def reported(weight: float = 0.5) -> Transducer:
    arcs = {(0, "report"): (1, "report", 1.0)}
    for c in ("insult", "threat"):
        arcs[1, c] = (1, c, weight)
    return Transducer(arcs)


def targeted(insult: float = 1.5, threat: float = 2.0, lone_threat: float = 0.4) -> Transducer:
    """States: 0 nothing, 1 target seen, 2 insult seen, 3 both (the bonus is paid once)."""
    arcs = {(0, "target"): (1, "other", 1.0), (2, "target"): (3, "bonus", insult - 1.0),
            (0, "insult"): (2, "insult", 1.0), (1, "insult"): (3, "insult", insult)}
    for s in range(4):
        arcs[s, "threat"] = (s, "threat", threat if s in (1, 3) else lone_threat)
    return Transducer(arcs)


def compose(a: Transducer, b: Transducer, labels=CLASSES) -> Transducer:
    """a, then b over a's output; weights multiply."""
    names, arcs, todo = {(a.start, b.start): 0}, {}, [(a.start, b.start)]
    while todo:
        p, q = todo.pop()
        for c in labels:
            p2, out, w = a.step(p, c)
            q2, out2, w2 = b.step(q, out)
            if (p2, q2) not in names:
                names[p2, q2] = len(names)
                todo.append((p2, q2))
            arcs[names[p, q], c] = (names[p2, q2], out2, w * w2)
    return Transducer(arcs)


def grammar() -> Transducer:
    return compose(compose(negation(), reported()), targeted())


@dataclass(frozen=True)
class Lexicon:
    """Weights of insult words and stems; the other classes are fixed lists."""
    words: dict
    stems: dict

    def classify(self, token: str) -> tuple[str, float]:
        if token in self.words:
            return "insult", self.words[token]
        for n in STEMS:
            if token[:n] in self.stems and len(token) >= n:
                return "insult", self.stems[token[:n]]
        return FIXED.get(token, ("other", 0.0))


TOKEN = re.compile(r"[^\W_]+")
CLAUSE_END = re.compile(r"[.!?;\n]")


def clause_score(clause: str, lexicon: Lexicon, machine: Transducer) -> float:
    """Sum of the weights that the machine gives a lower-cased clause."""
    state, total, last = machine.start, 0.0, 0.0
    for token in TOKEN.findall(clause):
        kind, value = lexicon.classify(token)
        state, out, weight = machine.step(state, kind)
        if out in ("insult", "threat"):
            last = value
            total += value * weight
        elif out == "bonus":
            total += last * weight
    return total


def _triggers(lexicon: Lexicon):
    """Automaton over everything that can start an insult or threat."""
    import ahocorasick
    a = ahocorasick.Automaton()
    for w in [*lexicon.words, *THREATS]:
        a.add_word(w, (len(w), True))
    for w in lexicon.stems:
        a.add_word(w, (len(w), False))
    a.make_automaton()
    return a


def matched_clauses(text: str | None, lexicon: Lexicon, machine: Transducer, automaton) -> list[tuple[int, int, float]]:
    """(start, end, score) of each clause of the lower-cased text that scores."""
    t, out, done = (text or "").lower(), [], -1
    for end, (n, whole) in automaton.iter(t):
        at = end - n + 1
        if at < done or at and t[at - 1].isalnum() or whole and t[end + 1:end + 2].isalnum():
            continue
        low = done if done > 0 else 0
        for m in ".!?;\n":
            low = max(low, t.rfind(m, low, at) + 1)
        stop = CLAUSE_END.search(t, end + 1)
        high = stop.start() if stop else len(t)
        score = clause_score(t[low:high], lexicon, machine)
        if score > 0:
            out.append((low, high, score))
        done = high
    return out


def clause_features(text: Column, lexicon: Lexicon) -> Column:
    """struct<clauses, total, top> of a text's matched clauses."""
    made = []

    @F.pandas_udf("struct<clauses:bigint,total:double,top:double>")
    def run(texts: pd.Series) -> pd.DataFrame:
        if not made:
            made.append((_triggers(lexicon), grammar()))
        automaton, machine = made[0]
        found = [[s for _, _, s in matched_clauses(t, lexicon, machine, automaton)] for t in texts]
        return pd.DataFrame({"clauses": [len(x) for x in found], "total": [float(sum(x)) for x in found],
                             "top": [max(x, default=0.0) for x in found]})
    return run(text)


def id_fold(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """``(text, toxic)`` of at most ``bound`` labelled ids outside fold 0, by hash order.

    Ids whose labels disagree and null labels teach nothing."""
    ids = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(id_fold(F.col("doc_id")) != 0)
           .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("high"))
           .filter("toxic = high").select("doc_id", "toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
            .groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text"))   # copies teach once
            .select(F.coalesce("text", F.lit("")).alias("text"), "toxic"))


def learn_lexicon(sample: DataFrame, limit: int = MAX_LEARNED) -> Lexicon:
    """Words and stems that stand in toxic texts far more often than in others."""
    sizes = sample.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    toxic, clean = int(sizes[0] or 0), int(sizes[1] or 0) - int(sizes[0] or 0)
    words = {w: 3.0 for w in INSULTS}
    if not toxic or not clean:
        return Lexicon(words, {})
    tokens = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))

    def cut(words: Column, n: int) -> Column:        # whole words (0) or their first n characters, as "n:text"
        return F.transform(words, lambda w: F.concat(F.lit(f"{n}:"), F.substring(w, 1, n) if n else w))
    # distinct strings go through a hash set, distinct structs would be compared pairwise
    units = let(tokens, lambda t: F.array_distinct(F.concat(*[cut(t, n) for n in (0, *STEMS)])))
    floor = max(MIN_TEXTS, MIN_SHARE * toxic)
    counts = (sample.select("toxic", F.explode(units).alias("x")).groupBy("x").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
              .select(F.substring("x", 1, 1).cast("int").alias("n"), F.expr("substring(x, 3)").alias("u"), "t", "c")
              .filter(F.length("u") >= F.greatest(F.col("n"), F.lit(3)))
              .filter((F.col("t") >= floor) & (F.col("t") / toxic >= MIN_TOXIC / (1 - MIN_TOXIC) * F.col("c") / clean)))
    n, base = F.col("t") + F.col("c"), toxic / (toxic + clean)
    evidence = 2 * (F.col("t") * F.log(F.col("t") / (n * base))
                    + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - base)))).otherwise(0.0))
    counts = counts.filter(evidence >= MIN_EVIDENCE)
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    rows = counts.withColumn("w", odds).orderBy(F.desc("w"), "n", "u").limit(limit).collect()   # at most `limit`
    stems: dict[str, float] = {}
    for r in sorted((r for r in rows if r["n"]), key=lambda r: (r["n"], r["u"])):
        if not any(r["u"][:n] in stems for n in STEMS if n < r["n"]):
            stems[r["u"]] = r["w"]
    words |= {r["u"]: r["w"] for r in rows if not r["n"] and not any(r["u"][:n] in stems for n in STEMS)}
    return Lexicon(words, stems)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: Lexicon
    weights: tuple          # of the three features below
    intercept: float


def _features(f: Column) -> list[Column]:
    return [F.log1p(f["total"]), F.log1p(f["top"]), (f["clauses"] > 0).cast("double")]


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> ToxicityModel:
    """Lexicon, then logistic regression; without both classes, fixed weights."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    ship_package(docs.sparkSession)
    sample = materialize(training_rows(docs, labels, bound), "toxicity-sample", partitions=None)
    lexicon = learn_lexicon(sample)
    seen = sample.agg(F.min("toxic"), F.max("toxic")).first()
    if seen[0] == seen[1]:
        return ToxicityModel(lexicon, (1.0, 1.0, 1.0), -3.0)
    names = ["a", "b", "c"]
    data = sample.select(F.col("toxic").cast("double").alias("label"), clause_features(F.col("text"), lexicon).alias("f"))
    data = data.select("label", *[c.alias(n) for n, c in zip(names, _features(F.col("f")))])
    data = VectorAssembler(inputCols=names, outputCol="features").transform(data)
    model = LogisticRegression(regParam=1e-3, maxIter=50).fit(materialize(data, "toxicity-features"))   # at most `bound` rows
    return ToxicityModel(lexicon, tuple(float(x) for x in model.coefficients), float(model.intercept))


def score(text: Column, model: ToxicityModel, name: str = "__tox") -> tuple[Column, Column]:
    """(features, probability): select the first as ``name``, then the second."""
    f = F.col(name)
    z = F.lit(model.intercept)
    for w, c in zip(model.weights, _features(f)):
        z = z + F.lit(w) * c
    return clause_features(text, model.lexicon).alias(name), 1.0 / (1.0 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))


def toxicity(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, bound: int = SAMPLE_ROWS) -> DataFrame:
    """Every row with ``__row`` (``carry`` columns, all by default), ``clauses``
    (matched), ``score`` (0 to 1) and ``predicted``.

    Null and empty texts match no clause and get the score of such a text;
    equal texts score equally; repeated rows stay; a null id teaches nothing.
    """
    model = fit(docs, labels, bound)
    kept = F.struct(*[F.col(f"`{c}`") for c in (carry or docs.columns)])
    features, probability = score(F.col("text"), model)
    got = docs.select(kept.alias("__row"), features)
    return (got.withColumn("score", probability)
            .select("__row", F.col("__tox.clauses").alias("clauses"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
