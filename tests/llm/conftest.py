import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark, tmp_path_factory):
    """Staged tables of these tests go to one folder, if the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))


@pytest.fixture
def odd(spark):
    """Documents with nulls in any column, empty, blank and long texts, ties, repeated rows and
    columns named as those that operators make."""
    long_text = "\n".join(" ".join(f"w{(i * 7 + j) % 997}" for j in range(40)) for i in range(300))
    rows = [
        (1, "The cat sat on the mat and then it slept all day long", "en", "a", 3, "x"),
        (2, "The cat sat on the mat and then it slept all day long", "en", "a", 3, "x"),
        (2, "The cat sat on the mat and then it slept all day long", "en", "a", 3, "x"),
        (3, None, None, None, None, None),
        (4, "", "", "", 0, ""),
        (5, " \n\t ", "en", "b", 1, "y"),
        (None, "A text without an identifier", None, "a", 2, None),
        (None, "A text without an identifier", None, "a", 2, None),
        (6, long_text, "en", "a", None, "z"),
        (7, "x" * 70_000, "en", "c", 1, "z"),
        (8, "don't  stop now — 12 élan ß 字\r\n\r\nDON'T", "fr", "é", 1, "z"),
    ]
    columns = "doc_id long, text string, lang string, source string, size long, fp string"
    return spark.createDataFrame(rows, columns)


@pytest.fixture
def none(odd):
    return odd.limit(0)
