"""A mini corpus of hotel records and texts, as literals."""

from pyspark.sql import DataFrame, SparkSession

ROWS = [
    ("r1", True, "c1", "red lion hotel del mar 4*", "B-hotelname I-hotelname I-hotelname B-localarea I-localarea B-starrating"),
    ("r2", True, "c2", "grand plaza downtown 3*", "B-hotelname I-hotelname B-localarea B-starrating"),
    ("r3", True, "c3", "red plaza downtown 4*", "B-hotelname I-hotelname B-localarea B-starrating"),
    ("t1", False, "c1", "won 4* red lion dm $65 4/25", "O B-starrating B-hotelname I-hotelname B-localarea O O"),
    ("t2", False, "c2", "3* grand plaza dwntn", "B-starrating B-hotelname I-hotelname B-localarea"),
    ("t3", False, None, "what is at the airport", "O O O O O"),
]


def mentions(spark: SparkSession) -> DataFrame:
    rows = [(i, r, c, w.split(), b.split()) for i, r, c, w, b in ROWS]
    return spark.createDataFrame(rows, "mention_id string, is_record boolean, true_cluster string, words array<string>, labels array<string>")


def one(spark: SparkSession, column, **values):
    """The value of a column expression over one row."""
    from pyspark.sql import functions as F

    def lit(v):
        if isinstance(v, list):
            return F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")
        return F.lit(v)

    return spark.range(1).select(*[lit(v).alias(k) for k, v in values.items()]).select(column.alias("out")).first()["out"]
