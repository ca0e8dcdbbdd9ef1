import pytest

from cohortloom.llm.common import reachable

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def workers_reach_the_package(spark):
    reachable(spark)


@pytest.fixture(scope="session")
def awkward(spark):
    """Documents with every awkward case: nulls, empties, ties, repeats, a long text, clashing names."""
    line = "A line that is held by several documents of the table"
    long = " ".join(f"w{i % 3001}x{i % 17}" for i in range(20_000))
    rows = [
        (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 3), (4, "one", "en", "b", 3),
        (5, f"{line}\nown words of five here\n{line}", "en", "a", 9), (6, f"  {line.upper()} \nmore", "en", "a", 9),
        (7, f"x\n{line}\n\n", "de", "b", 9), (8, long, "en", "a", len(long)), (9, long, "en", "a", len(long)),
        (10, long + " tail", "en", "b", len(long)), (None, line, "en", "b", 4), (None, None, None, None, None),
        (11, "the same few words again and again " * 30, "en", "c", 0), (12, "one", "en", "b", 3),
        (13, "Mail eva.b12@mail3.example.com or +1 (212) 555-0188, card 4111 1111 1111 1111.", "en", "c", 1),
        (14, "Mrs. Anna Berg met Mr. Paul Lund; Mrs. Berg wrote eva.b12@mail3.example.com from 10.2.3.4.", "en", "c", 1),
        (16, "x <|endoftext|> y <|STARTOFTEXT|>\n<|startoftext|>z", "en", "c", 1),
        (15, "été déjà vu, naïve café — 日本 語 text with wide　space", "fr", "c", 1),
    ]
    schema = ("doc_id long, text string, lang string, source string, n_chars long, n long, part int, row long, "
              "grp long, found string, ids int")
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "f", 5) for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("false")
