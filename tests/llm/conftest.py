import random

import pytest

SF = "/root/testdata/sf0.001"


def odd_texts() -> list[str | None]:
    """Nulls, empty and blank texts, repeats, a very long text, separators and characters of all kinds."""
    rng = random.Random(7)
    words = ["alpha", "beta", "Gamma", "the", "of", "naïve", "straße", "x", "42", "日本", "K", "İx"]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return [None, "", " \t\n\v\f\r ", "one", "a b c d e", prose[0], prose[0], *prose, "\n".join(["same line", "same line", "", "", "other"]), "x\x1cy\x85z w", long, "a" * 5000, "\u0000|#*$", "<|endoftext|> and <|endoftext|>"]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with odd texts, null languages and sources, a repeated row and extra columns with clashing names."""
    rows = [(k, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else f"src{k % 2}", 1, "z", 0.5) for k, t in enumerate(odd_texts())]
    rows.append(rows[5])
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int, kept string, score double")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
