"""Inputs that every operator has to bear, and readers of results."""

from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
PROSE = " ".join(WORDS) + " and so it ends here."
LONG = " ".join(f"word{i} runs on" for i in range(30_000)) + "."

#: doc_id, text, source
DOCUMENTS = [
    (1, PROSE, "a"),
    (2, PROSE, "a"),
    (3, PROSE.replace("alpha", "alfa"), "b"),
    (3, PROSE.replace("alpha", "alfa"), "b"),
    (None, PROSE, None),
    (4, None, "a"),
    (5, "", "b"),
    (6, " \n\t ", None),
    (7, "One line.\nOne line.\nÄöü 😀 line.", ""),
    (8, LONG, "c"),
    (None, None, None),
]

#: names that operators use for columns of their own
CLASHES = (
    "id key print begin root component_id fingerprint quality kept size shard slot n chunk part bin pool name block phase"
    " position names again found n_replaced text_key _n _bucket _print _key place length cls copies cuts"
    " words spaced facts licence fim fim_key restored form output"
).split()


def documents(spark, rows=DOCUMENTS):
    """The documents with the usual columns and all clashing ones."""
    fields = [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
    values = [
        (i, text, None, source, None if text is None else len(text), *["x"] * len(CLASHES)) for i, text, source in rows
    ]
    return spark.createDataFrame(values, T.StructType(fields))


def dicts(df):
    return [r.asDict() for r in df.collect()]
