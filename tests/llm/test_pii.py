import hashlib
import math
import random
import re
from collections import Counter

from pagequarry.llm import pii as P
from pagequarry.llm.pii import find_pii

#: The plain patterns of the contract.
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(t):
    out = []
    for j, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub(r"[^0-9]", "", m[0])
            good = {"email": True, "ip": all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]
            if good:
                out.append((m.start(), j, k, m.end()))
    return [f"{k}:{s}:{e}" for s, _, k, e in sorted(out)]


def test_base_spans_and_discovery(spark):
    r = random.Random(5)
    rows = [(0, None), (1, ""), (1, "a@b.c%x@d.e a@b..c 1.2.3.4.5.6.7.8 300.1.1.1 4111 1111 1111 1111 +1 (744) 555-2801"), (3, "x" * 20000 + "@b.com"), (4, "1 " * 5000), (5, "4" * 20000), (6, "1.2.3." + "0" * 50 + "7"), (None, "é🎉 4111111111111111 🎉 \x01\x02 a@b.co")]
    rows += [(10 + i, "".join(r.choice("0123456789.- +()@ab%4411") for _ in range(r.randint(0, 60)))) for i in range(400)]
    rows += [(9000 + i, f"hello my account id u{i}@x{i}.com then my account id {100 + i}x, done") for i in range(20)]
    found = find_pii(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected, got = Counter(), Counter()
    for i, t in rows:
        b = base(t)
        c = Counter(x.split(":")[0] for x in b)
        expected[(i, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(",".join(b).encode()).hexdigest())] += 1
    for x in found:
        got[(x.doc_id, x.n_email, x.n_ip, x.n_card, x.n_phone, x.base_sha256)] += 1
        if x.doc_id and x.doc_id >= 9000:
            text = dict(rows)[x.doc_id]
            spans = [s.split(":") for s in x.spans.split(",")]
            assert x.n_discovered == 1 and text[int(spans[1][1]) : int(spans[1][2])] == f"{x.doc_id - 8900}x"
            assert set(base(text)) <= set(x.spans.split(","))
    assert got == expected
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def chain():
    """20 seeds and 10 new ids in one context, these ids in a second one, with 16 further ids."""
    rows = [f"his login name u{i}@x{i}.com was seen" for i in range(20)]
    rows += [f"his login name id{i}x was seen" for i in range(10)]
    rows += [f"the badge number id{i}x too" for i in range(10)] + [f"the badge number zz{i}q too" for i in range(16)]
    return rows + ["the 3 of them came 2 by 2"] * 5 + ["was seen the name"] * 3


def test_believed_instances_raise_further_patterns(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(chain())] * 2
    found = find_pii(spark.createDataFrame(rows, "doc_id long, text string, rid int, kind string").repartition(3)).collect()
    spans = {(x.doc_id, x.n_discovered, x.spans) for x in found}
    assert len(found) == len(rows) and len(spans) == len(chain())
    for i, n, s in spans:
        text = chain()[i]
        if 20 <= i < 56:
            a, b = map(int, s.split(":")[1:])
            assert n == 1 and s.startswith("email:") and re.fullmatch(r"id\d+x|zz\d+q", text[a:b])
        else:
            assert n == 0 and s == ",".join(base(text))


def brute_force(texts, min_different=3, min_share=0.3, min_score=1.0):
    """The accepted patterns and believed instances, from plain loops over all words."""
    shape = lambda w: re.sub(r"([Aa9])\1+", r"\1+", re.sub("[0-9]", "9", re.sub("[a-z]", "a", w)))
    tokens, total = [], Counter()
    for t in texts:
        seeds = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base(t))]
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", t)]
        for k, (a, b, w) in enumerate(words):
            total["w " + w.lower()] += 1
            if not re.search("[0-9@]", w):
                continue
            total["s " + shape(w.lower())] += 1
            seed = [s[2] for s in seeds if s[0] < b and a < s[1]]
            near = lambda j: words[j][2].lower() if 0 <= j < len(words) else None
            two, one, after = near(k - 2), near(k - 1), near(k + 1)
            ps = [("<2", "w " + two, "w " + one)] if two and one else []
            ps += [("<1", "w " + one)] if one else []
            ps += [(">1", "w " + after)] if after else []
            ps += [(n, "s " + shape(w2)) for n, w2 in (("<shape", one), (">shape", after)) if w2 and re.search("[0-9@]", w2)]
            tokens.append((w.lower().lstrip("\"'([<").rstrip("\"')]>.,;:!?#*$%&"), seed[0] if seed else None, [" ".join(p) for p in ps], ps))
    edges, totals, believed = Counter(), {}, {}
    for instance, seed, names, ps in tokens:
        if seed:
            believed[instance] = seed
        for name, p in zip(names, ps):
            edges[name, instance] += 1
            totals[name] = min(total[k] for k in p[1:])
    while True:
        good = {}
        for name in totals:
            n = {i: c for (p, i), c in edges.items() if p == name and i in believed}
            if len(n) < min_different:
                continue
            share = min(1.0, sum(n.values()) / totals[name])
            score = share * math.log2(len(n))
            kinds = Counter()
            for i, c in n.items():
                kinds[believed[i]] += c
            if share >= min_share and round(score, 12) >= min_score:
                good[name] = (round(share, 9), round(score, 9), max(P.SEEDS, key=lambda k: (kinds[k], -P.SEEDS.index(k))))
        new = {i: max((good[p][1], p, good[p][2]) for (p, j) in edges if j == i and p in good)[2] for (q, i) in edges if q in good and i not in believed}
        if not new:
            return good, believed
        believed |= new


def test_scores_against_brute_force(spark):
    r = random.Random(11)
    words = ["mail", "call", "at", "on", "id", "+1", "x9", "7-7"]
    texts = chain()
    for i in range(150):
        kind = [f"m{r.randint(0, 30)}@host.com", f"10.0.{r.randint(0, 9)}.{r.randint(0, 9)}", f"+1 (555) 20{r.randint(0, 9)}-1234", f"k{r.randint(0, 20)}", f"{r.randint(0, 400)}"]
        texts.append(" ".join(r.choice([*words, *kind, r.choice(kind)]) for _ in range(r.randint(0, 12))))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    occurred = P.store(P.occurrences(P.store(P.matches(docs), "matches")), "occurrences")
    good, believed = P.accepted(occurred, P.context_counts(docs, occurred))
    expected, instances = brute_force(texts)
    assert {x.pattern: (round(x.share, 9), round(x.score, 9), x.kind) for x in good.collect()} == expected and len(expected) > 6
    assert {x.instance: x.kind for x in believed.collect()} == instances


def test_keys_in_quotes(spark):
    r = random.Random(3)
    key = lambda digits: "".join(r.choice(digits) for _ in range(39)) + digits[-1]
    texts = [f'der token = "{key("0123456789abcdef")}" war' for _ in range(6)] + [f'DER TOKEN = "{key("0123456789ABCDEF")}"!! war', "die 0123456789012345678901234567890123 kam", "ein token fehlt"]
    found = {x.doc_id: x for x in find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[i].n_secret for i in range(9)] == [1] * 6 + [0] * 3 and [found[i].n_discovered for i in range(9)] == [0] * 6 + [1, 0, 0]
    a, b = map(int, found[6].spans.split(":")[1:])
    assert texts[6][a - 1] == '"' and texts[6][b] == '"' and b - a == 40
