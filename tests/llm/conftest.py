import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    """Documents from (doc_id, text[, lang[, source]]) with columns named like the operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        extra = "fp size bucket group home key shard slot score lang_pred component _pattern _repeats hashes base spans row token text_crc32 held".split()
        return df.selectExpr("*", *[f"'x' as {c}" for c in extra])

    return make


@pytest.fixture
def prose():
    """Seeded words of a small made-up vocabulary."""
    import random

    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice("ba ke lo mi nu ti".split()) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make
