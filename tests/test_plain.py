"""Queries without SQL against plain versions."""

import re
from collections import defaultdict

from tessera.queries import QUERIES
from tessera.sources.domain import Tables

SF = "/root/testdata/sf0.01"


def test_locate_span(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {r.item_id: (r.find, r.start, r.end) for r in QUERIES["x8_locate_span"](spark, SF).collect()}
    assert set(got) == set(texts)
    for item, text in texts.items():
        find = text.split(" ")[2]
        m = next((m for m in re.finditer(rf"(?={re.escape(find.lower())})", text.lower()) if not text[max(0, m.start() - 1) : m.start()].isalnum() and not text[m.start() + len(find) : m.start() + len(find) + 1].isalnum()), None)
        assert got[item] == (find, *((m.start(), m.start() + len(find)) if m else (None, None)))


def fold(text):
    import unicodedata

    return "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in text.lower()).split()


def test_longest_shared_run(spark):
    """All runs of four words or more between a document and an item, by extending every equal place."""
    items = {r.item_id: fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: fold(r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    at = defaultdict(list)
    for item, w in items.items():
        for i in range(len(w) - 3):
            at[tuple(w[i : i + 4])].append((item, i))
    want = {}
    for doc, w in docs.items():
        for i in range(len(w) - 3):
            for item, j in at.get(tuple(w[i : i + 4]), ()):
                n, other = 4, items[item]
                while i + n < len(w) and j + n < len(other) and w[i + n] == other[j + n]:
                    n += 1
                if n > want.get((doc, item), (0,))[0]:
                    want[doc, item] = (n, " ".join(w[i : i + n]))
    got = {(r.doc_id, r.item_id): (r.length, r.run) for r in QUERIES["x14_longest_shared_run"](spark, SF).collect()}
    assert got == want and want


def test_barycentric_order(spark):
    sf = SF.replace("sf0.01", "sf0.001")
    t = Tables(spark, sf)
    order = {r.id: r.order_in_parent for r in t.nodes.filter("kind = 'learning_objective'").collect()}
    edges = [(r.src_id, r.dst_id) for r in t.current.filter("edge_type = 'prerequisite'").collect() if r.src_id in order and r.dst_id in order]
    layer = dict.fromkeys(order, 0)
    for _ in order:
        for a, b in edges:
            layer[b] = max(layer[b], layer[a] + 1)
    place = {}
    for k in sorted(set(layer.values())):
        here = [x for x in order if layer[x] == k]

        def key(x):
            above = [place[a] for a, b in edges if b == x and a in place]
            return (sum(above) / len(above) if above else (len(here) - 1) / 2, order[x], x)

        place |= {x: i for i, x in enumerate(sorted(here, key=key))}
    got = {r.id: (r.layer, r.position) for r in QUERIES["o11_barycentric"](spark, sf).collect()}
    assert got == {x: (layer[x], place[x]) for x in order}
