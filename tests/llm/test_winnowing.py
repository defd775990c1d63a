import hashlib

import numpy as np
from hypothesis import given, settings, strategies as st

from vitrine.llm import winnowing as W

TEXT = st.text(alphabet="abé漢 ", max_size=200)


def brute(text, k, window):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return []
    k = min(k, len(codes))
    hashes = W._run_hashes(codes, k).tolist()
    window, out = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        low = min(hashes[i : i + window])
        place = max(j for j in range(i, i + window) if hashes[j] == low)
        if not out or out[-1][1] != place:
            out.append((low, place))
    return out


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 12), st.integers(1, 40))
def test_equals_brute_force(text, k, window):
    hashes, places = W.fingerprint(text, k, window)
    assert list(zip(hashes.tolist(), places.tolist())) == brute(text, k, window)


def test_stretches(monkeypatch):
    text = "".join(chr(97 + (i * i) % 23) for i in range(900)) + "ab" * 300
    monkeypatch.setattr(W, "STRETCH_BITS", 7)
    hashes, places = W.fingerprint(text, 5, 20)
    assert list(zip(hashes.tolist(), places.tolist())) == brute(text, 5, 20)


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT, st.text(alphabet="abcdefgh", min_size=20, max_size=40))
def test_match_guarantee(before, other, shared):
    a, b = W.fingerprint(before + shared, 8, 13)[0], W.fingerprint(other + shared + before, 8, 13)[0]
    assert set(a.tolist()) & set(b.tolist())


def test_edits(spark, odd_rows, odd_docs, clashing, no_docs):
    ordered = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in ordered]
    for docs in (odd_docs.repartition(3), clashing):
        rows = W.compare_edits(docs, partitions=3).collect()
        assert len(rows) == len(texts)
        expected = []
        for i, text in enumerate(texts):
            after = texts[(i + 1) % len(texts)]
            changed = W.edited(text, after)
            (mine, places), (theirs, moved) = W.fingerprint(text), W.fingerprint(changed)
            expected.append(
                (
                    str(ordered[i][0]),
                    len(text),
                    hashlib.sha256(changed.encode()).hexdigest(),
                    W.as_hex(mine),
                    places.tolist(),
                    W.as_hex(theirs),
                    moved.tolist(),
                    W.likeness(mine, theirs),
                    W.likeness(mine, W.fingerprint(after)[0]),
                )
            )
        got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.fingerprint, r.positions, r.edited_fingerprint, r.edited_positions, r.near_edited, r.near_next) for r in rows]
        assert sorted(got) == sorted(expected)
    assert W.compare_edits(no_docs).count() == 0
    assert W.compare_edits(odd_docs.where("doc_id = 1")).head().near_next == 1.0


def test_fingerprints_with_places(odd_docs, no_docs):
    rows = W.fingerprints(odd_docs).collect()
    for r in rows:
        hashes, places = W.fingerprint(r.text or "")
        assert [f.pos for f in r.fingerprint] == places.tolist() and [f.hash for f in r.fingerprint] == hashes.astype(np.int64).tolist()
    assert W.fingerprints(no_docs).count() == 0
