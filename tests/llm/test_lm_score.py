import math
import random
from collections import Counter

from strandmill.llm import lm_score


def brute(rows, order, held_out, alpha=0.4):
    docs = [(i, (t or "").split()) for i, t in rows]

    def count(words):
        return Counter(tuple(words[k : k + n]) for n in range(1, order + 1) for k in range(len(words) - n + 1))

    corpus, total = Counter(), sum(len(w) for _, w in docs)
    for _, w in docs:
        corpus.update(count(w))
    out = []
    for i, w in docs:
        c = corpus - count(w) if held_out else corpus
        n = total - len(w) if held_out else total

        def log_score(gram, c=c, n=n):
            if len(gram) == 1:
                return math.log(c[gram] / n) if c[gram] else -math.log(n + 1)
            return math.log(c[gram] / c[gram[:-1]]) if c[gram] else math.log(alpha) + log_score(gram[1:])

        s = sum(log_score(tuple(w[max(0, k - order + 1) : k + 1])) for k in range(len(w)))
        out.append((i, len(w), round(s, 6)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice("a b c d e f the é".split()) for _ in range(rng.randint(0, 25)))) for k in range(60)]
    rows += [(60, None), (61, ""), (62, "zzz"), (5, rows[5][1]), (None, "a b"), (63, "the " * 300)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, batch int")
    for order, held_out in ((2, True), (3, True), (3, False), (1, True)):
        got = lm_score.score(df, order=order, held_out=held_out, batches=5).collect()
        assert sorted(((r.doc_id, r.n_words, round(r.log_score, 6)) for r in got), key=str) == brute(rows, order, held_out)
    assert lm_score.score(df.limit(0)).count() == 0
