"""Personal data: base spans against plain regular expressions, discovery on planted contexts."""

import random
import re

from pyspark.sql import functions as F

from plumbline.llm import pii

PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def luhn(d):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0


def plain(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, m.end(), kind))
    return sorted(out)


def test_base_spans_match_plain_patterns(spark):
    rng = random.Random(9)
    bits = ["a", "B.", "@", ".", "-", "_", "+", " ", "\n", "1", "25", "255", "256", "4111 1111 1111 1111", "4845168114407329", "x@y.z", "a@b.c_d@e.f", "é", "🙂", "+1 (017) 555-7713", "1.2.3.4", "007.0.0.1", "(", ")"]
    texts = [None, "", "a@b.c@d.e", "🙂 x@y.zz 1.2.3.4.5.6.7.8", "9" * 3000, "a" * 20000 + " x@y.z", "+1" + " " * 5000 + "2", "1.1.1.1 " * 700]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t, "k", 0) for i, t in enumerate(texts)] + [(None, "a@b.c", "k", 0), (1, "", "k", 0)], "doc_id bigint, text string, key string, spans int")
    got = pii.find(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id is not None:
            assert [(s.start, s.order, s.end, s.kind) for s in r.base] == plain(texts[r.doc_id]), texts[r.doc_id]
    assert pii.find(docs.where(F.lit(False))).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    texts = [f"{word()} {word()} call hotline: +1 (0{i:02}) 555-77{i:02} {word()} the {word()}" for i in range(20)]
    hidden = [f"{word()} call hotline: (0{i:02}) 555-66{i:02} now" for i in range(5)]
    clean = [f"{word()} the {1000 + i} {word()} in 20{i:02} and {word()} hotline {word()} section {i}.{i}" for i in range(40)]
    texts += hidden + clean
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    for i, t in enumerate(texts):
        base, spans = got[i].base, got[i].spans
        assert [s for s in spans if s in base] == base
        more = [t[s.start : s.end] for s in spans if s not in base]
        assert more == ([re.search(r"\(0.*[0-9]", t)[0]] if t in hidden else []), (t, more)
        assert all(s.kind == "phone" for s in spans)


def test_accepted_instances_make_new_patterns(spark):
    """Keys of a known form teach one context; what stands there unseen teaches a second, which finds the rest."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(5))
    odd = [f"Zq-{rng.randrange(10**8):08}-K" for _ in range(12)]
    sha = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(30)]
    texts = [f'{word()} api token = "{x}"; {word()}' for x in sha] + [f"{word()} API\ttoken =\n{x}!! {word()}" for x in odd[:6]]
    texts += [f"{word()} vault entry {x}" for x in odd[:6]] + [f"vault entry <{x}> {word()}" for x in odd[6:]]
    clean = [f"{word()} commit {sha[0][::-1]} {word()}", f"{word()} in 2024 and {word()} 123456", f"about {odd[0]}x", "x" * 3000 + " 1" * 50]
    rows = spark.createDataFrame([(i, t, "", 1) for i, t in enumerate(texts + clean)], "doc_id bigint, text string, one string, key int")
    got = {r.doc_id: r for r in pii.find(rows).collect()}
    for i, t in enumerate(texts):
        want = next(x for x in sha + odd if x in t)
        assert [t[s.start : s.end] for s in got[i].spans if s not in got[i].base] == [want], t
    for i in range(len(texts), len(texts) + len(clean)):
        assert got[i].spans == got[i].base


def test_pattern_scores_match_a_plain_graph(spark):
    """Which instances are accepted, against the same rounds on plain dictionaries."""
    rng = random.Random(11)
    contexts = ["mail", "id no", "ref", "the", "call"]
    values = [f"u{i}@x.yz" for i in range(9)] + [f"N{i:05}" for i in range(12)] + [str(i) for i in range(6)]
    lines = [" ".join(w for _ in range(6) for w in (rng.choice("abcd"), rng.choice(contexts), rng.choice(values if rng.random() < 0.8 else ["z", "of"]))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {(r.doc_id, s.start, s.end, s.kind) for r in pii.find(rows).collect() for s in r.spans if s not in r.base}
    found, follow = [], {}
    for d, t in enumerate(lines):
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", t)]
        for i, (a, b, w) in enumerate(words):
            before = [x[2].lower() for x in words[:i]]
            ctx = [("1", before[-1] if before else None), ("2", before[-2] if len(before) > 1 else None, before[-1] if before else None)]
            for c in ctx:
                follow[c] = follow.get(c, 0) + 1
            if re.search("[0-9@]", w):
                found.append((d, a, b, w, ctx, "email" if re.fullmatch(PATTERNS[0][1], w) else None))
    known, score, total = {(w, k) for *_, w, _, k in found if k}, {}, 0.0
    while True:
        weight = dict(score) | {x: 1.0 for x in known}
        stats = {}
        for *_, w, ctx, _ in found:
            for c in ctx:
                if (w, "email") in weight:
                    s = stats.setdefault(c, [0.0, set()])
                    s[0] += weight[w, "email"]
                    s[1] |= {w} if (w, "email") in known else set()
        p = {c: min(0.99, s[0] / (max(follow[c], s[0]) + 1)) for c, s in stats.items() if len(s[1]) >= 3}
        rest = {}
        for *_, w, ctx, _ in found:
            for c in set(ctx) & set(p):
                rest.setdefault(w, set()).add(c)
        score = {}
        for w, cs in rest.items():
            left = 1.0
            for c in cs:
                left *= 1 - p[c]
            score[w, "email"] = 1 - left
        new = {x for x, s in score.items() if s >= 0.8 and ("@" in x[0] or sum(map(str.isdigit, x[0])) >= 5)} - known
        before, total = total, sum(score.values())
        if not new and total - before <= 1e-3 * total:
            break
        known |= new
    strong = {c for c, x in p.items() if x >= 0.4}
    want = {(d, a, b, "email") for d, a, b, w, ctx, k in found if k is None and (w, "email") in known and set(ctx) & strong}
    assert got == want and any(k is None and (w, "email") in known for *_, w, _, k in found)
