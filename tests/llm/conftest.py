from __future__ import annotations

import random

import pytest

pytest.importorskip("grovekit.llm")

#: Names that operators use themselves; all of them stand in the odd table too.
CLASHING = "h place shard slot fp rep n key bucket tail topic n_tokens probability draw kept score predicted c0 c1 crc line sha dropped term cell_source v c".split()
ODD = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def prose(rnd: random.Random, words: int) -> str:
    syllables = "ka lo mi ne ro su ti va wen xor yul zam".split()
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 4))) for _ in range(words))


def odd_rows() -> list[tuple]:
    rnd = random.Random(11)
    base = [prose(rnd, 60) for _ in range(6)]
    texts = [None, "", " \t\n", "A", "a", "Zwölf Boxkämpfer jagen", "x" * 30_000, prose(rnd, 12_000), "🙂 é́ <|endoftext|>", "The The The", base[0], base[0].upper(), base[0], base[1] + "\n" + base[2], base[2] + "\n" + base[1]]
    texts += [base[3], base[3] + " ka", base[3], base[4].replace("a", "o", 1), base[4], "\n".join(base)]
    rows = [(i * 3, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, base[5], "en", "s0", 3), (None, None, None, None, None), (None, base[0], "de", "s1", None)]
    return [(*r, *["x"] * len(CLASHING)) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, ids twice or missing, names that clash."""
    return spark.createDataFrame(odd_rows(), ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, parts=3):
        full = [(i, t, "en", "s0", len(t or "")) if not isinstance(t, tuple) else (i, *t) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(parts)

    return build
