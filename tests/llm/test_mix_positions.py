"""Training positions of every pass."""

from cases import frame

from quiresift.llm import curriculum


def test_each_pass_has_a_position(spark):
    data = [(i, "w " * (5 + i % 7), None, "abc"[i % 3], None) for i in range(90)]
    got = curriculum.mix(frame(spark, data), slopes=(0.0, 0.0, 0.0)).collect()
    assert {r.copies for r in got} >= {1, 2}
    for r in got:
        assert len(r.positions) == r.copies and r.positions[:1] == ([] if r.position is None else [r.position])
        if r.copies == 2:  # an even schedule: a pass later is a source's size later
            assert abs(r.positions[1] - r.positions[0] - r.source_size / r.target) < 1e-8
