import hashlib
import string
import zlib

import pytest

from quarry.llm import merkle

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, low=False):
    text = row.text.translate(LOWER) if low and row.text is not None else row.text
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    out = []
    for nodes in levels[:-1]:
        at = i // 16 * 16
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1 : at + 16])))
        i //= 16
    return out


def expected(rows):
    sources = {}
    for r in rows:
        sources.setdefault(r.source, []).append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        sources[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in sources[s]]) for s in order}
    above = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(sources[s]):
            path = siblings(trees[s], i) + siblings(above, k)
            digest = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
            for left, right in path:
                digest = sha(left + digest + right)
            root = above[-1][0]
            out.append((r.doc_id, trees[s][0][i], trees[s][-1][0], root, sha("".join(a + b for a, b in path)), digest, digest == root))
    return sorted(out, key=repr)


def got(docs):
    return sorted(map(tuple, merkle.manifest(docs).collect()), key=repr)


def test_documents_by_brute_force(spark, documents):
    assert got(documents) == expected(documents.collect())


def test_odd_documents_by_brute_force(spark, odd, none):
    doubled = odd.union(odd).union(odd.where("doc_id IS NULL"))
    assert got(doubled) == expected(doubled.collect())
    assert got(none) == []


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (16, 1), (17, 1), (257, 2), (300, 290), (4097, 1), (4400, 3)])
def test_shapes_of_trees(spark, n, sources):
    docs = spark.range(n).selectExpr("id AS doc_id", f"IF(id % {sources} = 0, NULL, concat('s', id % {sources})) AS source", "'en' AS lang", "id AS n_chars", "concat('Text ', id) AS text")
    assert got(docs) == expected(docs.collect())


@pytest.mark.parametrize("n", [1, 2, 16, 17, 31, 256, 257, 300, 4095, 4096])
def test_walk_of_a_block(n):
    nodes = [sha(str(i)) for i in range(n)]
    levels = tree(nodes)
    height = len(levels) - 1
    held = 0

    def stream():
        nonlocal held
        for x in nodes:
            held += 1
            yield x

    for i, path in enumerate(merkle.paths(stream(), height, levels[-2] if height > 1 else None)):
        assert path == siblings(levels, i)
        assert held - i <= 257  # what is read ahead stays within the desired subtree
        assert merkle.fold(nodes[i], path) == levels[-1][0]
    assert i == n - 1


def test_a_walk_finds_nodes_that_were_not_made_from_its_leaves():
    nodes = [sha(str(i)) for i in range(40)]
    with pytest.raises(ValueError, match="bottom up"):
        list(merkle.paths(iter(nodes), 2, [sha("x")] * 3))
