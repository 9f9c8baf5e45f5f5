import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = "/root/testdata/sf0.001"

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "size string, score string, part int, h string, n string, component_id string"
)


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    clash = ("x", None, 1, "h", "n", None)
    base = [
        (1, "The cat sat on the mat. It slept all day.\nThen it woke up and ate.", "en", "a", 67),
        (1, "The cat sat on the mat. It slept all day.\nThen it woke up and ate.", "en", "a", 67),
        (2, "", "en", "a", 0),
        (3, None, None, None, None),
        (4, "  \t\n ", "fr", "b", 5),
        (5, "Un chat dort sur le tapis du salon. Il rêve à l'été.", "fr", "b", 52),
        (6, "Der Hund läuft über die große Straße. Es regnet heute sehr stark.", "de", None, None),
        (7, "123 456 !!! ...", None, "c", 15),
        (8, "ΑΣ İstanbul ǅ Straße 東京 🙂 <|endoftext|> it's we'll", "xx", "c", 40),
        (9, "long " * 40_000 + "end", "en", "a", 200_003),
        (None, "a row without a number but with words enough to count", "en", "a", 53),
        (None, "a row without a number but with words enough to count", None, None, None),
        (12, "The cat sat on the mat. It slept all day.\nThen it woke up and ate.", "en", "z", 67),
        (13, "x", "es", "b", 1),
        (14, "El perro corre por la calle grande. Hoy llueve mucho en la ciudad.", "es", "b", 66),
    ]
    return [r + clash for r in base]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder with odd documents, labels and vectors."""
    root = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), SCHEMA).write.parquet(f"{root}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, 0), (5, 1, None), (6, None, 0), (9, 0, 0), (None, 1, 0), (14, 1, 0), (14, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    v = [1.0] + [0.0] * 7
    w = [0.99, 0.1] + [0.0] * 6
    vectors = [
        (1, v, 0, 7), (2, w, 0, 7), (3, w, 1, 7), (4, v, None, 7), (5, None, 0, 7), (6, [0.0] * 8, 0, 7),
        (7, [float("nan")] * 8, 0, 7), (8, [None] + v[1:], 0, 7), (9, [2.0] + [0.0] * 7, 0, 7), (10, v[:4], 0, 7),
        (11, [float("inf")] * 8, 0, 7), (12, [], 0, 7), (2, w, 0, 7),
    ]
    schema = "vec_id long, embedding array<float>, label int, n_links int"
    spark.createDataFrame(vectors, schema).write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    """The same tables without rows."""
    root = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    schema = "vec_id long, embedding array<float>, label int"
    spark.createDataFrame([], schema).write.parquet(f"{root}/embeddings.parquet")
    return str(root)


@pytest.fixture(scope="session")
def folders(odd, empty):
    return {"odd": odd, "empty": empty, "sf": SF}
