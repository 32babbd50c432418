"""F4 offset_vote_histogram: however many postings there are, sums of votes are not shuffled, and lists of postings a few times for each core."""

from tidemark.operators import tiles, voting


def test_sums_of_votes_are_not_shuffled(spark, monkeypatch):
    query = spark.createDataFrame([(f"q{i % 9}", i % 3, 40 * i) for i in range(200)], "query_id string, hash long, t_us long")
    reference = spark.createDataFrame([(i % 4, 37 * i) for i in range(300)], "hash long, t_us long")
    names = ["query_id", "bin", *voting.TALLIED]
    want = sorted(map(tuple, voting._by_joins(query, reference, 100, None, []).select(names).collect()))
    monkeypatch.setattr(voting, "TILE_POSTINGS", 50)
    monkeypatch.setattr(voting, "BLOCK", 1)
    found = voting.by_tiles(query, reference, 100, None)
    assert sorted(map(tuple, found.select(names).collect())) == want
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    before = "\n".join(lines[: next(i for i, line in enumerate(lines) if "MapInArrow" in line)])
    assert "Aggregate" not in before and "Repartition" not in before
    # with blocks of one landmark there would be 200
    assert 1 < found.rdd.getNumPartitions() <= voting.CORE_BLOCKS * spark.sparkContext.defaultParallelism


def test_postings_beyond_what_is_held_lie_in_a_file():
    import numpy as np

    for held in (5, 1 << 20):
        posts = tiles._Postings(held)
        posts.add(np.array([1, 1, 2]), np.array([2, 1, 3]), np.array([9, 4, 6, 3, 2, 1]))
        posts.add(np.array([2, 7]), np.array([2, 1]), np.array([0, 8, 5]))
        hashes, starts, times = posts.index()
        assert (hashes.tolist(), starts.tolist(), times.tolist()) == ([1, 2, 7], [0, 3, 8, 9], [4, 6, 9, 0, 1, 2, 3, 8, 5])
        assert (posts.file is not None) == (held == 5)
