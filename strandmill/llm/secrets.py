"""Secret scan: three fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of 16 or more of A-Z a-z 0-9 + / _ = - that holds a letter or digit, or what a finding of a
pattern leaves of a run, if that is as long. The network reads the
candidate with what stands before and after it; a long one it reads in overlapping windows, and the most suspicious
window decides, so that a key at the end of a path is seen whole. It is trained in numpy on labelled findings (`labelled_findings`, made
by a seeded generator: keys and tokens of common forms in common settings, against identifiers, paths, dates,
serial numbers and other harmless runs), calibrated on held-out findings, and accepts what lies above the highest
threshold that keeps the required recall there. Documents are scanned where they lie; nothing is shuffled.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, byte_slices, let_go, texts_of

# The patterns of the base findings.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
_WORDS = ("passw", "secret", "token", "api")

BEFORE, INSIDE, AFTER = 28, 40, 4
LENGTH = BEFORE + INSIDE + AFTER
#: Windows follow each other at this distance, so INSIDE - STEP characters in a row are always whole in one.
STEP = 8


def base_findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, leftmost and non-overlapping within each kind."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower()
        if any(w in low for w in _WORDS):
            out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


LEAST = 16
_CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
_ALNUM = re.compile(r"[A-Za-z0-9]")


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets, less the findings that they overlap; what is left counts if it is long enough."""
    out = []
    for m in _CANDIDATE.finditer(text):
        at, stop = m.span()
        for _, s, e in sorted((f for f in taken if f[1] < stop and at < f[2]), key=lambda f: f[1:]):
            out.append((at, min(s, stop)))
            at = max(at, e)
        out.append((at, stop))
    return [(s, e) for s, e in out if e - s >= LEAST and _ALNUM.search(text, s, e)]


def _classes() -> np.ndarray:
    """A class for each ASCII code: 0 pads, letters and digits have their own, 1 is any other character."""
    own = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 \n\"'=:/+-_.,;()<>{}[]#&?@"
    table = np.ones(128, np.int64)
    for k, c in enumerate(own):
        table[ord(c)] = k + 2
    return table


_CLASS = _classes()
N_CLASSES = int(_CLASS.max()) + 1


def features(text: str, start: int, end: int) -> np.ndarray:
    """Character classes: BEFORE characters, the first INSIDE of the span, AFTER characters behind it."""
    out = np.zeros(LENGTH, np.int64)

    def put(at: int, piece: str) -> None:
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        out[at : at + len(codes)] = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], 1)

    before = text[max(0, start - BEFORE) : start]
    put(BEFORE - len(before), before)
    put(BEFORE, text[start : min(end, start + INSIDE)])
    put(BEFORE + INSIDE, text[end : end + AFTER])
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Spans of INSIDE characters that cover a candidate, the last one at its end; a short candidate is one span."""
    last = max(start, end - INSIDE)
    return [(s, min(end, s + INSIDE)) for s in (*range(start, last, STEP), last)]


class CharCnn:
    """Embedding, one convolution, maxima and means over the context and over the candidate, a logistic layer."""

    def __init__(self, dim: int = 8, filters: int = 24, width: int = 5, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "embed": rng.normal(0, 0.3, (N_CLASSES, dim)),
            "conv": rng.normal(0, (width * dim) ** -0.5, (width * dim, filters)),
            "shift": np.zeros(filters),
            "out": rng.normal(0, 0.1, 4 * filters),
            "bias": np.zeros(1),
        }
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5
        split = BEFORE - width + 1
        self.parts = (slice(0, split), slice(split, LENGTH - width + 1))

    def _forward(self, x: np.ndarray):
        p = self.p
        grid = p["embed"][x]
        cols = np.concatenate([grid[:, k : LENGTH - self.width + 1 + k] for k in range(self.width)], axis=2)
        act = np.maximum(cols @ p["conv"] + p["shift"], 0)
        pooled = np.concatenate([f(act[:, s]) for s in self.parts for f in (lambda a: a.max(1), lambda a: a.mean(1))], axis=1)
        return cols, act, pooled, pooled @ p["out"] + p["bias"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[lo : lo + 512])[3] for lo in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x) + self.offset, -40, 40)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        cols, act, pooled, z = self._forward(x)
        dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / n
        dpool = dz[:, None] * p["out"][None]
        dact, f = np.zeros_like(act), act.shape[2]
        for k, s in enumerate(self.parts):
            part = act[:, s]
            best = part.argmax(1)
            np.add.at(dact[:, s], (np.arange(n)[:, None], best, np.arange(f)[None]), dpool[:, 2 * k * f : (2 * k + 1) * f])
            dact[:, s] += dpool[:, None, (2 * k + 1) * f : (2 * k + 2) * f] / part.shape[1]
        dact *= act > 0
        dcols = dact @ p["conv"].T
        dembed, d = np.zeros_like(p["embed"]), p["embed"].shape[1]
        for k in range(self.width):
            at = x[:, k : LENGTH - self.width + 1 + k].ravel()
            part = dcols[:, :, k * d : (k + 1) * d].reshape(-1, d)
            dembed += np.stack([np.bincount(at, part[:, j], N_CLASSES) for j in range(d)], 1)
        return {
            "embed": dembed,
            "conv": np.tensordot(cols, dact, axes=([0, 1], [0, 1])),
            "shift": dact.sum((0, 1)),
            "out": pooled.T @ dz,
            "bias": np.array([dz.sum()]),
        }

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, rate: float = 0.01, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            for idx in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
                step += 1
                for k, g in self._gradients(x[idx], y[idx]).items():
                    m[k][0] = 0.9 * m[k][0] + 0.1 * g
                    m[k][1] = 0.99 * m[k][1] + 0.01 * g * g
                    self.p[k] = self.p[k] - rate * (m[k][0] / (1 - 0.9**step)) / (np.sqrt(m[k][1] / (1 - 0.99**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt's scaling by Newton steps, then the highest threshold with the recall."""
        z = self.logits(x)
        a, b = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(30):
            q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            g, h = q - target, q * (1 - q) + 1e-9
            gram = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
            da, db = np.linalg.solve(gram, [(g * z).sum() + 1e-3 * (a - 1), g.sum()])
            a, b = max(a - da, 1e-2), b - db
        self.scale, self.offset = a, b
        found = np.sort(self.probability(x[y == 1]))
        self.threshold = float(found[int((1 - recall) * len(found))])


def labelled_findings(n: int = 4000, seed: int = 3) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """(text, start, end) and 1 for a secret, 0 for a harmless run; half of each."""
    rng = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    # Beginnings, middles and ends of syllables in several languages.
    onsets = "b c d f g h j k l m n p r s t v w z bl br ch cl cr dr fl fr gl gr kn ph pl pr qu sc sch sh sl sp st str th tr wh y".split() + [""] * 12
    vowels = "a e i o u a e i o u a e i o y ai au ea ee ei eu ia ie io oi oo ou ue".split()
    codas = "b c d f g k l m n p r s t x z ch ck ct ft ght ld ll lt mp nd ng nk ns nt pf rch rd rk rm rn rs rt sch sh ss st th tz".split() + [""] * 30

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def chars(alphabet: str, low: int, high: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), int(rng.integers(low, high))))

    def word() -> str:
        return "".join(pick(onsets) + pick(vowels) + pick(codas) for _ in range(int(rng.integers(1, 4))))

    def secret() -> str:
        kind = int(rng.integers(6))
        if kind == 0:
            return chars(digits + "abcdef", 20, 24) + chars("ghij", 0, 2)
        if kind == 1:
            return chars(upper + lower + digits + "+/", 24, 64) + pick(("", "=", "=="))
        if kind == 2:
            return pick(("ghp_", "sk_live_", "xoxb-", "glpat-", "AIza", "pk_")) + chars(upper + lower + digits, 18, 40)
        if kind == 3:
            return chars(upper + lower + digits, 20, 48)
        if kind == 4:
            return chars(upper + lower, 20, 40)
        return chars(upper + digits, 16, 32)

    def harmless() -> str:
        kind = int(rng.integers(12))
        if kind == 8:
            return "".join(word() for _ in range(int(rng.integers(4, 9))))
        if kind == 9:
            return pick(("", "_", "-")).join(word().capitalize() for _ in range(int(rng.integers(3, 7))))
        if kind == 10:
            return pick(("_", "-", "/")).join(pick((word, lambda: word().upper()))() for _ in range(int(rng.integers(3, 8))))
        if kind == 11:
            return pick(("=", "-", "_")) * int(rng.integers(6, 30)) + pick(("", word(), chars(digits, 1, 4))) + pick("=-_") * int(rng.integers(6, 30))
        if kind == 0:
            return word() + "_" + word() + "_" + chars(digits, 1, 5) + "_" + word() + word()
        if kind == 1:
            return "/".join([word() for _ in range(4)] + [chars(digits, 2, 5)])
        if kind == 2:
            return f"{pick(('IMG', 'report', 'backup', 'log'))}-20{chars(digits, 2, 3)}-{chars(digits, 2, 3)}-{chars(digits, 2, 3)}-{word()}"
        if kind == 3:
            return "".join(word().capitalize() for _ in range(4)) + chars(digits, 1, 3)
        if kind == 4:
            return pick(lower) + chars(digits, 15, 20)
        if kind == 5:
            return chars(pick(lower) + pick(digits), 16, 30)
        if kind == 6:
            return word() + word() + word() + word() + word() + chars(digits, 1, 3) + "-" * int(rng.integers(0, 4)) + word()
        return "-".join([word(), word(), chars(digits, 1, 4), word(), word()])

    rows, y = [], np.zeros(n)
    for k in range(n):
        y[k] = k % 2
        lead = " ".join(word() for _ in range(int(rng.integers(2, 9))))
        rest = " ".join(word() for _ in range(int(rng.integers(0, 4))))
        run = secret() if k % 2 else harmless()
        while len(run) < LEAST:
            run += chars(upper + lower + digits, 4, 8) if k % 2 else word() + pick(("", pick(digits)))
        join = pick((" ", " ", ": ", ' "', "=", "\n", " (", "key ", "Bearer ")) if k % 2 else pick((" ", " ", " ", ": ", ' "', "=", "\n", " (", "file ", "see "))
        text = lead + join + run + pick((" ", "\n", ".", '"', ", ")) + rest
        start = len(lead) + len(join)
        rows.append((text, start, start + len(run)))
    return rows, y


def long_findings(n: int = 2000, seed: int = 5) -> tuple[list[tuple[str, int, int]], np.ndarray, list[tuple[int, int] | None]]:
    """(text, start, end), 1 for a run with a secret in it, and where that secret is: harmless runs of `labelled_findings`
    joined to long ones, half of them with a secret joined in."""
    rng = np.random.default_rng(seed)
    made, kinds = labelled_findings(4 * n, seed + 100)
    keys, plain = ([t[s:e] for (t, s, e), k in zip(made, kinds, strict=True) if k == want] for want in (1, 0))
    rows, y, where = [], np.zeros(n), []
    for k in range(n):
        y[k] = k % 2
        parts = [plain[int(i)] for i in rng.integers(len(plain), size=int(rng.integers(2, 6)))]
        at = int(rng.integers(len(parts) + 1)) if y[k] else None
        if at is not None:
            parts.insert(at, keys[int(rng.integers(len(keys)))])
        join = "/_-="[int(rng.choice(4, p=(0.7, 0.1, 0.1, 0.1)))]
        lead, run = made[int(rng.integers(len(made)))][0].split()[0] + " ", join.join(parts)
        rows.append((lead + run + " end", len(lead), len(lead) + len(run)))
        begin = len(lead) + sum(len(p) + 1 for p in parts[:at]) if at is not None else 0
        where.append((begin, begin + len(parts[at])) if at is not None else None)
    return rows, y, where


@lru_cache(maxsize=2)
def trained(recall: float = 0.98, n: int = 4000) -> CharCnn:
    """The network, trained on the windows of two thirds of the findings and calibrated on the rest as `scan` judges them.

    A window of a long run counts as a secret if it holds 16 of the secret's characters, as harmless if it holds none.
    """
    rows, y = labelled_findings(n)
    more, z, where = long_findings(n // 2)
    runs = [(r, (r[1], r[2]) if k else None) for r, k in zip(rows, y, strict=True)] + list(zip(more, where, strict=True))
    labels = np.concatenate([y, z])
    held = np.concatenate([np.arange(n) // 2 % 3 == 0, np.arange(len(more)) // 2 % 3 == 0])
    x, known = [], []
    for (text, start, end), key in (r for r, h in zip(runs, held, strict=True) if not h):
        for s, e in windows(start, end):
            shared = min(e, key[1]) - max(s, key[0]) if key else 0
            if shared >= 16 or shared <= 0:
                x.append(features(text, s, e))
                known.append(float(shared > 0))
    model = CharCnn()
    model.fit(np.stack(x), np.array(known))
    best = []
    for (text, start, end), _ in (r for r, h in zip(runs, held, strict=True) if h):
        seen = np.stack([features(text, s, e) for s, e in windows(start, end)])
        best.append(seen[model.logits(seen).argmax()])
    model.calibrate(np.stack(best), labels[held], recall)
    return model


def _order(finding: tuple) -> tuple:
    return finding[1], KINDS.index(finding[0])


def scan(text: str, model: CharCnn) -> list[tuple[str, int, int, float]]:
    """All findings by start, then kind: (kind, start, end, probability)."""
    base = base_findings(text)
    runs = candidates(text, base)
    out = [(*b, 1.0) for b in base]
    if runs:
        parts = [windows(s, e) for s, e in runs]
        seen = model.probability(np.stack([features(text, s, e) for spans in parts for s, e in spans]))
        p = np.maximum.reduceat(seen, np.cumsum([0, *map(len, parts[:-1])]))
        out += [("model", s, e, float(q)) for (s, e), q in zip(runs, p, strict=True) if q >= model.threshold]
    return sorted(out, key=_order)


_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", recall: float = 0.98) -> DataFrame:
    """doc_id and spans (kind, start, end exclusive in code points, score) by start, then kind.

    Null and empty texts have none; rows are judged one by one, so repeated rows give repeated results.
    """
    model = docs.sparkSession.sparkContext.broadcast(trained(recall))
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    bounded_batches(docs.sparkSession)

    def run(batches):
        let_go()
        for part in (p for batch in batches for p in byte_slices(batch)):
            found = [[dict(zip(("kind", "start", "end", "score"), f, strict=True)) for f in scan(t, model.value)] for t in texts_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return picked.mapInArrow(run, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, spans {_SPANS}")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = "[SECRET]", recall: float = 0.98) -> DataFrame:
    """The documents with every finding (overlapping ones together) replaced by `mask`; all columns stay, and the
    length column follows a text that changed.

    Null and empty texts pass unchanged; repeated rows are judged alike, each for itself.
    """
    bounded_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained(recall))

    def cut(text: str) -> str:
        out, last = [], 0
        spans: list[list[int]] = []
        for _, s, e, _ in scan(text, model.value):
            if spans and s < spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        for s, e in spans:
            out += [text[last:s], mask]
            last = e
        return "".join([*out, text[last:]]) if spans else text

    def run(batches):
        let_go()
        for part in (p for batch in batches for p in byte_slices(batch, text_col)):
            cols = dict(zip(part.schema.names, part.columns, strict=True))
            old = cols[text_col].to_pylist()
            new = [t if t is None else cut(t) for t in old]
            cols[text_col] = pa.array(new, pa.string())
            if length_col in cols:
                sizes = cols[length_col].to_pylist()
                cols[length_col] = pa.array([z if n == o else len(n) for n, o, z in zip(new, old, sizes, strict=True)], cols[length_col].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: findings of each kind, the digest of the base ones, and all spans."""
    found = find_secrets(docs, id_col, text_col)

    def of(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        of("model").alias("n_model"),
    )
