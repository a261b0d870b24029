"""Tables with every awkward row: null, empty and very long texts, copies, clashing columns."""

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


WORDS = [f"wort{i}" if i % 3 else f"les{i}ée" for i in range(400)]


def prose(seed: int, n: int) -> str:
    """Words without long repeats; equal seeds give equal texts."""
    out, x = [], seed * 7919 + 1
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)])
        if i % 9 == 8:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def awkward_rows() -> list[tuple]:
    """(doc_id, text, lang, source, then columns whose names operators use themselves)."""
    texts = [None, "", " \n\t ", "word", "a b c d", prose(1, 60), prose(1, 60), "".join(c.upper() if c.isascii() else c for c in prose(1, 60)),
             prose(2, 60), prose(2, 59) + " other", "x" * 5000, prose(3, 30000), "\n".join(["same line"] * 50),
             "<|endoftext|> and  two blanks ", "😀 é   ￿", "12 34 ?!", prose(4, 25) + "\n" + prose(4, 25)]
    langs = [None, "de", "fr"]
    rows = [(i, t, langs[i % 3], None if i % 4 == 0 else f"s{i % 2}", 1, "c", False, 0.5, 7, 9)
            for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose(1, 60), "de", "s0", 1, "c", False, 0.5, 7, 9), (-5, None, None, None, *rows[0][4:])]
    return rows


AWKWARD = ("doc_id long, text string, lang string, source string, n_shingles int, component_id string, "
           "kept boolean, quality double, shard int, size int")


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), AWKWARD).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], AWKWARD)
