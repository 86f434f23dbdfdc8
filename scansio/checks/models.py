"""Distributed models.

Fitted numbers are not SQL.  What must hold of them is: every row of the test
part is scored, scores are probabilities, fits repeat, saved models score alike,
and a word that decides the answer is learned.  SQL states each as true.
"""

from pyspark.sql import functions as F

from scansio import fixtures
from scansio.checks.registry import KEY, check, kept
from scansio.checks.sampling import STANZA_SPLIT
from scansio.functions.text import clean_label, clean_text
from scansio.operators import models, sampling
from scansio.operators.metrics import exact_match
from scansio.plans import baseline
from scansio.session import stage

BUCKETS = 1 << 14
POSITIONS = list(range(1, 13))

#: The test part: the first quarter of each language in draw order.
_TEST = """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || lang || '|' || text)) AS rn FROM kept)
    WHERE rn <= ceil(n::DOUBLE * 0.25::DOUBLE)"""


def _rows(spark, folder):
    """Verse lines split into train and test rows."""
    return stage(sampling.split_exact(kept(spark, folder, "meter"), ["lang"], KEY, 0.25, held="test"), "fit")


def _split(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'").drop("split")


def _marked(rows):
    """A word in front of the text for each syllable says whether it is stressed."""
    marks = F.transform(F.split("meter", ""), lambda s, i: F.concat(F.lit("zz"), i, F.when(s == "+", "on").otherwise("off")))
    return rows.withColumn("text", F.concat_ws(" ", F.array_join(marks, " "), "text"))


@check("ova_scores", f"SELECT lang, text, meter, 12 AS positions, true AS probabilities FROM ({_TEST})")
def ova_scores(spark, folder):
    train, test = _split(_rows(spark, folder))
    model = models.fit_ova(train, "text", "meter", POSITIONS, BUCKETS, max_iter=10)
    scores = models.ova_scores(model, test, "text", POSITIONS)
    return scores.select("lang", "text", "meter", F.size("scores").alias("positions"),
                         F.forall("scores", lambda s: s.between(0.0, 1.0)).alias("probabilities"))


@check("ova_predictions", f"SELECT lang, text, true AS repeated FROM ({_TEST})")
def ova_predictions(spark, folder):
    """Scores of two fits on the same features, and their label sets where no score is at the threshold."""
    train, test = _split(_rows(spark, folder))
    features = models.ova_features(train, "text", "meter", POSITIONS, BUCKETS)
    one, two = (models.fit_positions(features, POSITIONS, BUCKETS, max_iter=10) for _ in range(2))
    first, second = (models.ova_scores(m, test, "text", POSITIONS).select(*KEY, "scores") for m in (one, two))
    pairs = F.arrays_zip("scores", "again")
    return first.join(second.withColumnRenamed("scores", "again"), KEY).select(
        *KEY, F.forall(pairs, lambda p: F.abs(p["scores"] - p["again"]) < 1e-6).alias("repeated"))


@check("ngram_report", f"""SELECT lang, count(*) AS samples, true AS found FROM ({_TEST}) GROUP BY lang""")
def ngram_report(spark, folder):
    """The n-gram baseline from lines to precision, recall and set match; a word in front decides each syllable."""
    rows = _marked(_rows(spark, folder))
    report = baseline.ngram_report(baseline.ngram_predictions(
        rows, POSITIONS, dim=64, buckets=BUCKETS, n=2, max_iter=40, rate=1.0, damping=0.01))
    return report.select("lang", "samples", (F.least("precision", "recall", "accuracy") >= 0.95).alias("found"))


@check("ngram_vectors", f"SELECT lang, text, 12 AS positions, true AS probabilities, true AS repeated FROM ({_TEST})")
def ngram_vectors(spark, folder):
    """The low-rank baseline started from word vectors: test rows scored by two fits, which must agree."""
    rows, vectors = _rows(spark, folder), stage(_words(spark, folder), "words")
    one, two = (baseline.ngram_predictions(rows, POSITIONS, vectors, dim=64, buckets=BUCKETS, max_iter=3) for _ in range(2))
    return one.join(two.select(*KEY, F.col("scores").alias("again")), KEY).select(
        *KEY, F.size("scores").alias("positions"), F.forall("scores", lambda s: s.between(0.0, 1.0)).alias("probabilities"),
        (F.col("scores") == F.col("again")).alias("repeated"))


def _words(spark, folder):
    """Word vectors for words of the texts: the first word of a document has the vector of its number."""
    docs, vectors = fixtures.documents(spark, folder), fixtures.table(spark, folder, "embeddings")
    word = F.split(clean_text("text"), " ")[0]
    return docs.join(vectors, docs["doc_id"] == vectors["vec_id"]).select(
        word.alias("word"), F.col("embedding").alias("vector")).groupBy("word").agg(F.min("vector").alias("vector"))


@check("model_round_trip", f"SELECT lang, text, 12 AS positions, true AS same FROM ({_TEST})")
def model_round_trip(spark, folder):
    train, test = _split(_rows(spark, folder))
    model = models.fit_ova(train, "text", "meter", POSITIONS, BUCKETS, max_iter=10)
    again = models.save_and_reload(model, spark)
    # both models score a row where it lies: no join brings its scores together; a row without a key has no pair, as in a join
    before = models.ova_scores(model, test, "text", POSITIONS).withColumnRenamed("scores", "before")
    both = models.ova_scores(again, before, "text", POSITIONS).dropna(subset=KEY)
    return both.select("lang", "text", F.size("before").alias("positions"), (F.col("before") == F.col("scores")).alias("same"))


@check("stanza_predictions", f"""SELECT s.stanza_id, s.stanza, c.label, true AS known, true AS learned
    FROM ({STANZA_SPLIT}) s JOIN (SELECT stanza, (row_number() OVER (ORDER BY stanza) - 1)::INTEGER AS label
    FROM (SELECT DISTINCT stanza FROM labelled_stanzas)) c ON c.stanza = s.stanza WHERE s.split = 'dev'""")
def stanza_predictions(spark, folder):
    """Class numbers of held-out stanzas; the classifier must beat the share of the commonest class."""
    rows = fixtures.stanzas(spark, folder).select(
        "stanza_id", clean_text("text").alias("text"), clean_label("stanza").alias("stanza"))
    drawn = stage(sampling.split_stratified(rows, [], "stanza", [F.col("stanza_id").cast("string")], 0.25), "stanzas")
    train, held = drawn.filter("split = 'train'"), drawn.filter("split = 'dev'")
    model = models.fit_classifier(train, "text", "stanza", BUCKETS, max_iter=10)
    # read for the accuracy and for the rows, so terms are hashed once
    scored = stage(models.classify(model, held, "text").select("stanza_id", "stanza", "label", "predicted"), "classified")
    accuracy = scored.agg(exact_match("label", "predicted")).first()[0]
    sizes = held.groupBy("stanza").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    return scored.select(
        "stanza_id", "stanza", "label", F.col("predicted").between(0, len(model.stages[0].labels) - 1).alias("known"),
        F.lit(accuracy * sizes[1] > sizes[0]).alias("learned"))


_CHOICES = [{"max_iter": 0}, {"max_iter": 15, "rate": 3.0}, {"max_iter": 2, "rate": 1e-6}]


@check("sweep_best", f"""SELECT lang, '{str(_CHOICES[1]).replace("'", "''")}' AS parameters, 12 AS positions, true AS learned
    FROM kept GROUP BY lang""")
def sweep_best(spark, folder):
    """A sweep over all positions with a planted winner: only one choice takes steps that count."""
    train, test = _split(_marked(_rows(spark, folder)))
    best = models.sweep_best(models.sweep(train, test, "text", "meter", POSITIONS, _CHOICES, BUCKETS))
    return best.select("lang", "parameters", F.lit(len(POSITIONS)).alias("positions"), (F.col("accuracy") >= 0.95).alias("learned"))


def _word_lengths():
    """A predictor for tests: stressed when a word has five letters or more."""
    import numpy as np

    def predict(texts):
        return np.array(["".join("+" if len(w) >= 5 else "-" for w in str(t).split(" ")) for t in texts], dtype=object)

    return predict


@check("batch_score", "SELECT lang, text, meter AS pred FROM kept")
def batch_score(spark, folder):
    return models.batch_score(kept(spark, folder), ["text"], _word_lengths).select("lang", "text", "pred")
