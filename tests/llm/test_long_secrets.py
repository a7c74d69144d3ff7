import random
import string

from strandmill.llm import secrets


def test_keys_behind_long_prefixes_are_found(spark):
    rng = random.Random(3)
    rows = []
    for k in range(60):
        key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24))
        prefix = ("com/services/T00000000/B00000000/", "var/lib/build/jobs/release-2021/archive/modules/common/files/", "a/" * 40 + "v1/")[k % 3]
        rows.append((k, f"see {prefix}{key} now", key, f"see {prefix}index now"))
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, plain string")
    kept = [r for r in secrets.redact(df, length_col=None).collect() if r.key in r.text]
    assert len(kept) <= 3
    assert {r.plain for r in secrets.redact(df, "plain", None).collect()} == {r[3] for r in rows}


def test_windows_cover_a_run():
    for n in range(1, 200):
        spans = secrets.windows(5, 5 + n)
        assert spans[0][0] == 5 and spans[-1][1] == 5 + n and all(e - s <= secrets.INSIDE for s, e in spans)
        assert all(any(s <= at and at + min(n, 32) <= e for s, e in spans) for at in range(5, 5 + n - min(n, 32) + 1))
