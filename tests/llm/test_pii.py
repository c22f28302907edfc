from __future__ import annotations

import hashlib
import random
import re

from jobloom.llm.pii import BASE, KINDS, estimate, op7_weak_supervision_pii, pii_spans, redact

BRUTE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, kind in enumerate(BASE):
        for m in re.finditer(BRUTE[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind))
    return [(kind, a, b) for a, _, b, kind in sorted(out)]


def base_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii_spans(docs).collect()
    return {r.doc_id: sorted(((x.kind, x.start, x.end) for x in r.base), key=lambda x: (x[1], BASE.index(x[0]))) for r in rows}, rows


CASES = [
    None, "", "no data here", "a@b.c_d@e.f x", "a@b.c@d.e", "x@y", "@a.b", "..a@b.co.uk.", "é1.2.3.4é", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255", "1.2.3", "+1 (017) 555-7713 and +12", "++1 234 567 8901)",
    "+123 456 789 012 345 6", "4111 1111 1111 1111", "4111111111111111 4111-1111-1111-1111", "4111 1111  1111 1111", "4111111111111112", "x4111111111111111y", "41111111111111114111111111111111", "4111 1111 1111 1111 2",
    "378282246310005", "30569309025904 4222222222222", "mail\nme@x.org\r\nnow", "ü+1 234 567 8901", "1" * 40_000, "a" * 40_000 + "@", "a@" + "b." * 20_000, "1a11a" * 3_000, "+1" + "(" * 5_000, "9." * 3_000,
]


def test_base_spans_like_leftmost_search(spark):
    rng = random.Random(4)
    parts = ["a", "b.c", "@", ".", "-", " ", "+", "(", ")", "1", "22", "4111111111111111", "é", "_", "4", "1.2.3.4", "\n", "+1 (555) 123-4567", "x@y.zz"]
    texts = [*CASES, *("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(600))]
    got, rows = base_of(spark, texts)
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text if text is None or len(text) < 300 else i


def test_documents_and_digest(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op7_weak_supervision_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE] == [sum(x[0] == k for x in want) for k in BASE]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))


def test_adds_spans_that_labelers_agree_on(spark):
    texts = [f"my ssn is {100 + i}-22-{3333 + i} ok" for i in range(40)] + [f"call me, phone (212) 555-{1000 + i} now" for i in range(40)] + ['api token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'] * 30 + [f"version 000-00-000{i} build" for i in range(9)]
    _, rows = base_of(spark, texts)
    kinds = [[x.kind for x in sorted(r.spans, key=lambda x: x.start)] for r in sorted(rows, key=lambda r: r.doc_id)]
    assert all(k == ["ssn"] for k in kinds[:40]) and all(k == ["local_phone"] for k in kinds[40:80]) and all(k == ["secret"] for k in kinds[80:110])
    assert all(k == [] for k in kinds[110:])


def test_estimate_finds_the_unreliable_labeler():
    rng = random.Random(2)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.5
        vote = lambda p: (1 if true else -1) if rng.random() < p else (-1 if true else 1)  # noqa: B023, E731
        votes = (vote(0.9), vote(0.85), vote(0.8), rng.choice((-1, 1)))
        counts[votes] = counts.get(votes, 0) + 1
    model = estimate([("ssn", dict(zip(("pattern", "gazetteer", "context", "edges"), v, strict=True)), {}, float(n)) for v, n in sorted(counts.items())])
    right = {name: (kinds["ssn"][1][1] + kinds["ssn"][-1][0]) / 2 for name, kinds in model.reliability.items()}
    assert model.reliability["pattern"]["iban"] != model.reliability["pattern"]["ssn"]
    assert abs(right["pattern"] - 0.9) < 0.04 and abs(right["edges"] - 0.5) < 0.04
    assert estimate([]).weights == {}


def test_edges_and_redaction(spark):
    docs = spark.createDataFrame([(1, "write to a.b@c.org or +1 234 567 8901!", 5), (1, "write to a.b@c.org or +1 234 567 8901!", 6), (None, "1.2.3.4", 7), (2, None, 8), (3, "", 9)], "doc_id long, text string, base int")
    assert pii_spans(docs).count() == 5
    assert pii_spans(docs.limit(0)).count() == 0
    out = redact(docs)
    assert out.columns == docs.columns
    assert {r.base: r.text for r in out.collect()} == {5: "write to [email] or [phone]!", 6: "write to [email] or [phone]!", 7: "[ip]", 8: None, 9: ""}
    assert len(KINDS) == len(set(KINDS))


def test_long_secrets_are_taken_whole(spark):
    values = [hashlib.sha512(str(i).encode()).hexdigest() * 40 for i in range(30)]
    docs = spark.createDataFrame([(i, f'api token = "{v}" end') for i, v in enumerate(values)] + [(99, "token=" * 20_000 + "a" * 200_000)], "doc_id long, text string")
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in pii_spans(docs).collect()}
    assert all(found[i] == [("secret", 4, 4 + len(f'token = "{v}"'))] for i, v in enumerate(values))
    assert {r.text for r in redact(docs).where("doc_id < 99").collect()} == {"api [secret] end"}


def mod_97(country, body):
    turned = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(turned) % 97:02d}{body}"


def card(rng, size):
    digits = "4" + "".join(rng.choice("0123456789") for _ in range(size - 2))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def planted():
    """For each added kind true spans in sentences, and sentences with what only looks like one."""
    rng = random.Random(11)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(4, 9)))
    name = lambda: word().capitalize()
    given = lambda: rng.choice(["James", "Mary", "Hans", "Sophie", "María", "Pierre", "Karen"])
    true = {
        "secret": lambda: rng.choice([f'api_key = "{hexes(32)}"', f"token: {hexes(40)}", "AKIA" + "".join(rng.choice("ABCDEFGHJK23456") for _ in range(16)), f"aws_secret_key={hexes(40)}", f"password = {word()}{d(9)}"]),
        "local_phone": lambda: f"({rng.randint(2, 9)}{d(2)}) {rng.randint(2, 9)}{d(2)}-{d(4)}",
        "ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}",
        "iban": lambda: rng.choice([mod_97("DE", d(18)), mod_97("ES", d(20)), mod_97("GB", "WEST" + d(14))]),
        "masked_email": lambda: f"{word()} [at] {word()} [dot] com",
        "person": lambda: rng.choice([f"Mr. {name()}", f"{given()} {name()}", f"Dr. {given()} {name()}", f"Frau {name()}"]),
        "address": lambda: rng.choice([f"{rng.randint(1, 999)} {name()} Street", f"{name()}straße {rng.randint(1, 99)}", f"{rng.randint(1, 99)} rue de {name()}", f"Calle {name()} {rng.randint(1, 99)}"]),
    }
    cue = {"secret": "the config has", "local_phone": "please call", "ssn": "the social security number is", "iban": "pay to the bank account", "masked_email": "write to", "person": "regards,", "address": "deliver it to"}
    false = {
        "secret": lambda: rng.choice(["the secret: everything", "a token = whatever"]),
        "local_phone": lambda: f"isbn {rng.randint(0, 1)}{d(2)} {rng.randint(0, 1)}{d(2)} {d(4)}",
        "ssn": lambda: f"version 000-{d(2)}-{d(4)}",
        "iban": lambda: f"serial XQ{d(2)}{d(16)}",
        "masked_email": lambda: f"he was {word()} (at) {word()}",
        "person": lambda: f"{name()} {name()} went home",
        "address": lambda: f"{rng.randint(1, 99)} {word()} street",
    }
    rows, spans = [], {}
    for kind in true:
        for i in range(80):
            if i % 2:
                text = f"{word()} {word()} {false[kind]()} {word()}."
            else:
                head, span = f"{word()} {word()} {cue[kind] if i % 4 else word()} ", true[kind]()
                text = f"{head}{span}, {word()} {word()}."
                spans[len(rows)] = (kind, len(head), len(head) + len(span))
            rows.append((len(rows), text))
    return rows, spans


def test_recall_and_precision_of_planted_spans(spark):
    rows, spans = planted()
    plain = [(len(rows) + i, " ".join(["Some quiet words about nothing. In The End, he said; 12 of 40 were there"] * 5)) for i in range(200)]
    found = {r.doc_id: {(x.kind, x.start, x.end) for x in r.spans} for r in pii_spans(spark.createDataFrame(rows + plain, "doc_id long, text string")).collect()}
    for kind in {k for k, _, _ in spans.values()}:
        own = {i: s for i, s in spans.items() if s[0] == kind}
        hit = sum(s in found[i] for i, s in own.items())
        said = sum(x[0] == kind for i in found for x in found[i])
        assert hit >= 0.9 * len(own), (kind, hit, len(own), [(rows[i][1], found[i]) for i, s in own.items() if s not in found[i]][:5])
        assert hit >= 0.9 * said, (kind, hit, said)
    assert not any(found[i] for i, _ in plain)


def test_accounts_with_a_wrong_check_digit_in_context(spark):
    rng = random.Random(5)
    numbers = [card(rng, 16) for _ in range(40)]
    wrong = [x[:-1] + str((int(x[-1]) + 3) % 10) for x in numbers]
    docs = [(i, f"my card, please: {x}") for i, x in enumerate(numbers)] + [(100 + i, f"my card, please: {x} end") for i, x in enumerate(wrong)]
    found = {r.doc_id: [x.kind for x in r.spans] for r in pii_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(found[i] == ["card"] for i in range(40))
    assert sum(found[100 + i] == ["account"] for i in range(40)) in (0, 40)
