import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("key", "row", "fp", "block", "found", "tokens"))])


def words(seed: int, n: int) -> list[str]:
    """Made-up words; equal for equal arguments."""
    out, x = [], seed * 2654435761 + 12345
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append("".join("abcdefghilmnoprstu"[(x >> (7 * k + 8)) % 18] for k in range(2 + (x >> 58) % 6)))
    return out


def prose(seed: int, n: int) -> str:
    found = words(seed, n)
    return "\n".join(" ".join(found[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, copies, clashing column names."""
    rows = [(k, prose(k, 40 + 13 * k), "xx" if k % 2 else "yy", f"s{k % 3}") for k in range(20)]
    rows += [(20, rows[3][1], "xx", "s1"), (20, rows[3][1], "xx", "s1"), (21, rows[7][1] + " extra", None, None), (22, None, "xx", "s0"), (23, "", None, "s0"), (None, prose(99, 60), "yy", "s2"), (24, " \n\t ", "xx", None), (25, "1234 5678 #### !!", "yy", "s1"), (26, prose(5, 9000), "yy", "s2"), (27, "ab " * 700, "xx", "s2"), (28, None, None, None), (29, "é ü \x1cß İ", "yy", "s1")]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, *(["k", "r", None, "b", "f", "t"])) for r in rows], DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
