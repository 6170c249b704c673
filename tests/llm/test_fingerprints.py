import hashlib
import random

import numpy as np

from lumenspan.llm import fingerprints as fp


def brute(rows):
    """(doc_id, text) -> expected digest rows, and the next document of each."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        changed = fp.edited(text, following)
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), text, changed, following))
    return out


def compare(spark, docs):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    want = []
    for doc_id, n, digest, text, changed, following in brute(rows):
        one, two, three = (fp.fingerprints([t])[0] for t in (text, changed, following))
        want.append((doc_id, n, digest, one, two, fp.likeness(one, two), fp.likeness(one, three)))
        assert (want[-1][5] == 1) == (text == changed) and (want[-1][6] == 1) == (text == following)
    rank = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [tuple(r[c.split()[0]] for c in fp.PAIRED.split(", ")) for r in fp.fingerprint_documents(spark, docs).collect()]
    assert sorted(got, key=rank) == sorted(want, key=rank)


def test_whole_table(spark, real):
    compare(spark, real)


def test_odd_rows(spark, odd, empty):
    compare(spark, odd)
    assert fp.fingerprint_documents(spark, odd).count() == odd.count()
    assert fp.fingerprint_documents(spark, empty).count() == 0
    one = fp.fingerprint_documents(spark, odd.where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1


def test_spans_and_extensions():
    rng = random.Random(3)
    text = "".join(rng.choice("ab") for _ in range(400))
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    h = fp.PrefixHashes(codes)
    for _ in range(300):
        i, j = rng.randrange(400), rng.randrange(400)
        most = 400 - max(i, j)
        true = next((k for k in range(most) if text[i + k] != text[j + k]), most)
        assert h.extension(i, j, most) == true
        n = rng.randrange(most + 1)
        a, b = h.spans(np.array([i, j]), np.array([i + n, j + n]))
        assert (a == b) == (text[i : i + n] == text[j : j + n])


def test_likeness_is_a_lower_bound_of_common_ends():
    rng = random.Random(5)
    for _ in range(300):
        a = "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 500)))
        cut = rng.randrange(len(a) + 1)
        b = a[:cut] + "".join(rng.choice("xyz") for _ in range(rng.randrange(1, 60))) + a[cut:]
        got = fp.likeness(*fp.fingerprints([a, b]))
        assert len(a) / len(b) - 2 * fp.grid_step(len(b)) / len(b) <= got <= len(a) / len(b) < 1
        assert got == fp.likeness(*fp.fingerprints([b, a]))
