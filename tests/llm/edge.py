"""Tables with every awkward row: nulls, empty and very long texts, ties, repeats, and columns that clash."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, g int, k string, sig string, y int, score double, mix_copies int, q_path double, rest string, held_out string, `odd.name` int"
LONG = " ".join(f"word{i % 9973}" for i in range(60_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))
TEXTS = [
    (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, LONG),
    (7, LONG + " end"),
    (8, f"start {PASSAGE} stop"),
    (9, f"{PASSAGE}\n{PASSAGE}"),
    (None, f"lost {PASSAGE}"),
    (None, None),
    (10, "É ü 漢字 emoji 😀  nbsp   x\u0000y"),
    (11, "a " * 5000),
    (12, "short"),
    (-7, "negative id"),
    (2, "another text of the same id"),
    (13, "x" * 200_000),
]


def documents(spark: SparkSession) -> DataFrame:
    rows = [(i, t, None if n % 4 == 1 else "en", None if n % 5 == 2 else f"s{n % 3}", None if t is None else len(t), n, 1, "k", "s", 0, 0.5, 3, 0.1, "r", "h", n) for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def labels(spark: SparkSession) -> DataFrame:
    rows = [(1, 1, 0), (2, 1, None), (2, 0, 1), (3, None, 0), (6, 0, 1), (8, 1, 0), (None, 1, 1), (9, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def split(text: str | None) -> list[str]:
    """Words between ASCII white space."""
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
