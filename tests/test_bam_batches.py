import pyarrow as pa
import pytest

from strandmill.sources import bam

_KINDS = [("name", pa.string()), ("flag", pa.int32()), ("chrom", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", bam._CIGAR), ("mate_chrom", pa.string()), ("mate_pos", pa.int32()), ("bases", pa.string()), ("quals", pa.string()), ("tags", pa.map_(pa.string(), pa.string()))]


def _batch(rows):
    return pa.RecordBatch.from_pylist([dict(zip((c for c, _ in _KINDS), r, strict=True)) for r in rows], schema=pa.schema(_KINDS))


def test_a_batch_is_encoded_at_once_and_decoded_again():
    long = [("N" * 3, "x" * 100), ("HP", "1"), ("XI", "-2147483648"), ("XJ", "2147483648"), ("XK", "007")]
    rows = [
        ("a", 0, "c1", 70, 60, [{"op": "M", "len": 3}, {"op": "D", "len": 2}, {"op": "I", "len": 1}], "*", -1, "acGN", "IIII", [("RG", "s1.N")]),
        ("b", 4, "*", -1, 0, None, "c2", 5, "*", None, None),
        ("c", 16, "c2", (1 << 28) + 5, 255, [{"op": "S", "len": 2}, {"op": "M", "len": 3}], "c1", 9, "ACGTR", "*", long[1:]),
        ("d", 4, "c1", 16380, 1, [], "*", -1, "ACG", "!5~", []),
    ]
    data, ends = bam.encode(_batch(rows).slice(0, 4), {"c1": 0, "c2": 1})
    assert bam.encode(_batch(rows).slice(1, 3), {"c1": 0, "c2": 1})[0] == data[1:]
    back = [bam.decode(x[4:], ["c1", "c2"], "f") for x in data]
    assert [len(x) - 4 for x in data] == [int.from_bytes(x[:4], "little") for x in data]
    assert [(x["name"], x["chrom"], x["pos"], x["bases"], x["quals"]) for x in back] == [("a", "c1", 70, "ACGN", "IIII"), ("b", "*", -1, "", ""), ("c", "c2", (1 << 28) + 5, "ACGTR", "~~~~~"), ("d", "c1", 16380, "ACG", "!5~")]
    assert back[0]["cigar"] == [("M", 3), ("D", 2), ("I", 1)] and back[0]["end_pos"] == ends[0] == 75
    assert back[2]["tags"] == long[1:] and back[0]["tags"] == [("RG", "s1.N")]
    assert [int.from_bytes(x[14:16], "little") for x in data] == [bam.bgzf.bin_of(r[3], int(e)) if r[3] >= 0 else 4680 for r, e in zip(rows, ends, strict=True)]


def test_what_a_record_cannot_hold_is_an_error():
    row = ("a", 0, "c1", 70, 60, [], "*", -1, "AC", "II", [])
    for at, value in ((0, "n" * 255), (1, 1 << 16), (9, "I ")):
        with pytest.raises(ValueError):
            bam.encode(_batch([(*row[:at], value, *row[at + 1 :])]), {"c1": 0})
