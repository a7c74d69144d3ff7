"""Candidates of any kind, and the network on findings that its training generator did not make."""

import base64
import inspect
import random
import string

from strandmill.llm import secrets


def test_what_findings_leave_of_a_run():
    text = "x " + "a1B2" * 5 + "/" + "0123456789abcdef" * 2 + "/short " + "Q" * 16 + " " + "=" * 40
    base = secrets.base_findings(text)
    assert [k for k, _, _ in base] == ["hex"]
    start = base[0][1]
    assert secrets.candidates(text, base) == [(2, start), (text.index("QQ"), text.index("QQ") + 16)]
    assert secrets.candidates("", []) == secrets.candidates("-" * 50, []) == []


def test_recall_and_precision_elsewhere():
    rng = random.Random(11)

    def raw(n):
        return bytes(rng.randrange(256) for _ in range(n))

    letters = string.ascii_letters
    made = []
    for _ in range(100):
        made += [
            base64.b64encode(raw(rng.choice((18, 24, 32, 48)))).decode(),
            base64.urlsafe_b64encode(raw(24)).decode(),
            "ghp_" + "".join(rng.choice(letters + string.digits) for _ in range(36)),
            raw(16).hex().upper(),
            base64.b32encode(raw(20)).decode(),
            "".join(rng.choice(letters) for _ in range(32)),
        ]
    names = {n for m in (inspect, random, string, base64) for a in vars(m).values() for n in dir(a) if len(n) >= secrets.LEAST}
    paths = ["/".join(rng.sample(sorted(names), 2)) for _ in range(100)]
    compounds = ["".join(rng.choice(("der", "ung", "keit", "frei", "heit", "schaft", "wirt", "land", "stadt")) for _ in range(6)) for _ in range(100)]
    model = secrets.trained()

    def share(runs):
        return sum(any(k != "assign" for k, *_ in secrets.scan(f"see the value {r} in there", model)) for r in runs) / len(runs)

    assert share(made) >= 0.95
    assert share(sorted(names) + paths + compounds) <= 0.08
