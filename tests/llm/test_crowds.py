"""Crowds of op1: pairs that only shingles of very many sets tell, and repeated doc_ids among them."""

from heronwatch.llm import minhash

SCHEMA = "doc_id long, text string"


def crowd(short, n=1500, own=13):
    """Texts with a template and ``own`` words of their own, one less in the ``short`` ones: these
    are just over the limit with each other, under it with the rest, and have no rare shingle in common."""
    head = " ".join(f"t{k}" for k in range(100))  # 97 shingles
    return {i: f"{head} " + " ".join(f"o{i}x{k}" for k in range(own - (i in short))) for i in range(n)}


def test_op1_pairs_in_long_lists(spark):
    short = {100, 640, 1101, 1400}
    texts = crowd(short)
    sets = {i: {tuple(w[k : k + 4]) for k in range(len(w) - 3)} for i, w in ((i, texts[i].split()) for i in (0, 1, 100, 640))}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert linked(100, 640) and not linked(0, 1) and not linked(0, 100)
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(5)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, words=4).collect()}
    assert got == {i: 100 if i in short else i for i in texts}


def test_op1_repeated_ids_in_a_crowd(spark):
    """A doc_id with two texts of a crowd links what either of them links."""
    texts = list(crowd({7}, n=300).items())
    texts += [(5, texts[200][1] + " end"), (400, texts[5][1] + " end"), (None, texts[9][1])]
    docs = spark.createDataFrame(texts, SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id if r.component_id is not None else -1) for r in minhash.near_duplicates(docs, words=4).collect())
    assert got == sorted([(i, 5 if i == 200 else i) for i in range(300)] + [(5, 5), (400, 5), (-1, -1)])
