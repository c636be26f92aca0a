import random

from flowtide.llm import licenses as L


def test_align():
    assert L.align(list("xabcydez"), list("abcde")) == [(1, 0), (2, 1), (3, 2), (5, 3), (6, 4)]
    assert L.longest_increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(20))] for _ in range(2))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def longest_common(a, b):
    """The length of a longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b, 1):
            row[j] = above[j - 1] + 1 if x == y else max(row[j - 1], above[j])
    return row[-1]


def test_coverage_against_the_exact_alignment():
    """Never more words than the exact alignment finds; as many where words are unique; and nearly as many in edited license texts."""
    rng = random.Random(4)
    for _ in range(150):
        a = [rng.randrange(15) for _ in range(rng.randrange(25))]
        b = [x for x in a if rng.random() < 0.8]
        for k in range(rng.randrange(4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(15))
        assert len(L.align(a, b)) <= longest_common(a, b)
        a = rng.sample(range(60), 25)
        b = rng.sample(range(60), 25)
        assert len(L.align(a, b)) == longest_common(a, b)  # all words are unique: the anchors are the exact alignment
    worst = 1.0
    for text in L.TEMPLATES.values():
        words = L.words_of(text.encode())
        for rate in (0.05, 0.15):
            edited = [w for w in words if rng.random() > rate]
            for _ in range(int(len(words) * rate)):
                edited.insert(rng.randrange(len(edited) + 1), rng.choice([b"new", b"words", *words]))
            exact = longest_common(edited, words)
            worst = min(worst, len(L.align(edited, words)) / max(exact, 1))
    assert worst > 0.9


def test_scan_against_brute_force():
    """A scan reports a template exactly where some window aligns enough of its words exactly; near the limit it may miss by its bound."""
    s, rng = L.Scanner(), random.Random(6)
    for name in ("ISC", "MPL-2.0", "Unlicense", "GPL-3.0"):
        words = L.words_of(L.TEMPLATES[name].encode())
        for rate in (0.0, 0.1, 0.4, 0.6):
            kept = [w for w in words if rng.random() >= rate]
            text = [b"head"] * 30 + kept + [b"tail"] * 30
            coverage = longest_common(text, words) / len(words)
            found = name in [x[0] for x in s.scan(b" ".join(text))]
            assert found or coverage < L.LEAST_COVERAGE + 0.05, (name, rate, coverage)
            assert not found or coverage >= L.LEAST_COVERAGE, (name, rate, coverage)


def test_scan():
    s = L.Scanner()
    for name, text in L.TEMPLATES.items():
        words = text.split()
        edited = " ".join(w for i, w in enumerate(words) if len(words) < 20 or i % 15)
        found = s.scan(f"intro words here {edited} and an end".encode())
        assert name in [x[0] for x in found], name
        assert all(x[1] >= L.LEAST_COVERAGE for x in found)
    for name in ("BSD-2-Clause", "BSD-3-Clause"):
        assert [x[:2] for x in s.scan(f"Copyright some one. {L.TEMPLATES[name]} and code".encode())] == [(name, 1.0)]
    twice = f"{L.TEMPLATES['ISC']} middle text {L.TEMPLATES['ISC']}"
    assert [x[0] for x in s.scan(twice.encode())] == ["ISC", "ISC"]
    assert s.scan(b"the software is a thing that we license to you under terms of ours") == []


def test_documents(odd, empty):
    got = L.scan_licenses(odd).collect()
    assert [(r["doc_id"], r["license"], r["coverage"]) for r in got] == [(15, "MIT-line", 1.0)]
    assert L.scan_licenses(empty).count() == 0
