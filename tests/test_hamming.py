"""Nearest hashes against comparing with all references."""

import random

import pytest

from assayer.operators import hamming


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def frames(spark, images, references):
    return (spark.createDataFrame([(k, signed(h) if h is not None else None) for k, h in enumerate(images)], "id long, phash long"), spark.createDataFrame([(signed(h) if h is not None else None,) for h in references], "phash long"))


@pytest.mark.parametrize("many", [10, 0])
def test_equals_all_pairs(spark, monkeypatch, many):
    monkeypatch.setattr(hamming, "MANY", many)
    r = random.Random(4)
    references = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1, None]
    images = [None, 0, *(r.getrandbits(64) for _ in range(30))]
    for k in range(120):  # every distance from a reference up to far ones
        h = r.choice(references[:-1])
        for b in r.sample(range(64), k % 33):
            h ^= 1 << b
        images += [h, h]
    a, b = frames(spark, images, references)
    got = {x.id: x.distance for x in hamming.nearest_hash(a, b).collect()}
    assert got == {k: min((h ^ x).bit_count() for x in references if x is not None) if h is not None else None for k, h in enumerate(images)}


def test_no_references(spark):
    a, b = frames(spark, [1, None], [])
    assert [x.distance for x in hamming.nearest_hash(a, b).collect()] == [None, None]
    a, b = frames(spark, [], [5])
    assert hamming.nearest_hash(a, b).count() == 0


def test_near_images_meet_few_references(spark):
    r = random.Random(9)
    references = [r.getrandbits(64) for _ in range(3000)]
    images = [h ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for h in references]
    a, b = frames(spark, images, references)
    known = b.withColumnRenamed("phash", "_reference")
    met = sum(hamming.candidates(a, hamming.index(known, 16), 16, rings).count() for rings in ([0],))
    assert met < 5 * len(images) < len(images) * len(references) / 100
    assert hamming.steps(5000)[0] == (16, [0], 3) and hamming.steps(5000)[-1][2] == 64
