import hashlib

from strandmill.llm import chat

CONV = "conv_id long, turn long, role string, text string, msg int"


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "a<|turn|>b<|end|>\nc", "&lt;&amp;lsqb; [INST", "", None, "plain\n\ntext", "é漢🙂 <|", "&nl;"]
    rows = [(1, k, "assistant" if k % 2 else "user", t, 0) for k, t in enumerate(texts)] + [(2, 0, "ro\nle<|", "x", 0), (None, 3, None, None, 0)]
    done = chat.format_conversations(spark.createDataFrame(rows, CONV))
    back = {r.conv_id: [tuple(t) for t in r.turns] for r in done.select("conv_id", chat.read_back(done.formatted).alias("turns")).collect()}
    assert back == {1: [(r[2], r[3] or "") for r in rows[:8]], 2: [("ro\nle<|", "x")], None: [("", "")]}
    got = {r.conv_id: r for r in chat.report(done).collect()}
    learned = "".join(t or "" for t in texts[1::2])
    assert got[1].loss_chars == len(learned)
    assert got[1].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in rows[:8]).encode()).hexdigest()
    masked = {r.conv_id: [r.formatted[s.start : s.end] for s in r.loss_spans] for r in done.collect()}
    assert masked[2] == [] and len(masked[1]) == 4
    assert "</s>" not in done.where("conv_id = 1").first().formatted and "[INST]" not in done.where("conv_id = 1").first().formatted


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 1, "message", 0, "user", "hi"),
        (1, 2, "message", 1, "assistant", ""),
        (1, 3, "delta", 1, None, "he"),
        (1, 4, "delta", 1, None, "llo"),
        (1, 5, "message", 2, "user", "more"),
        (1, 6, "message", 3, "assistant", "old"),
        (1, 7, "regenerate", 1, "assistant", "new"),
        (1, 8, "delta", 1, None, "er"),
        (1, 9, "edit", 0, None, "hi!"),
        (1, 10, "message", 2, "user", "again"),
        (2, 1, "delta", 0, "user", "no start"),
    ]
    events = spark.createDataFrame(log, "conv_id long, seq long, kind string, msg int, role string, text string")
    got = sorted(map(tuple, chat.fold(events.repartition(4)).collect()))
    assert got == [(1, 0, "user", "hi!"), (1, 1, "assistant", "newer"), (1, 2, "user", "again"), (2, 0, "user", "no start")]


def test_repeated_turns_and_empty_table(spark):
    rows = [(1, 0, "user", "b", 0), (1, 0, "user", "a", 0), (1, 0, "user", "a", 0)]
    df = spark.createDataFrame(rows, CONV)
    assert chat.report(chat.format_conversations(df)).first().n_turns == 3
    assert chat.report(chat.format_conversations(df.limit(0))).count() == 0
