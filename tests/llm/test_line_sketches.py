"""Sketches rule out pairs of lines that share a rare word but little else, and no similar ones."""

import random

import pytest
from lexiloom.llm import line_dedup


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


@pytest.mark.parametrize("hot", [3, 512])
def test_few_pairs_are_verified(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rnd, seen = random.Random(5), {}
    lines = [rnd.sample(range(400), 30) for _ in range(300)]
    lines += [rnd.sample(range(400), 3) + x[3:] for x in lines[::5]] + [rnd.sample(range(400), 4) + x[4:] for x in lines[::7]]
    save = line_dedup.Scratch.save

    def saved(self, df, name):
        seen[name] = save(self, df, name)
        if name.startswith("pairs-"):
            seen[name] = seen[name].count()
            return save(self, df, name)
        return seen[name]

    monkeypatch.setattr(line_dedup.Scratch, "save", saved)
    text = [" ".join(f"w{i}" for i in x) for x in lines]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_similar_lines(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()}
    sets = [set(x) for x in lines]
    assert got == {i: int(any(similar(sets[i], sets[j]) for j in range(i))) for i in range(len(sets))}
    assert sum(got.values()) >= 30
    assert seen["pairs-1"] + seen["pairs-2"] <= 4 * sum(got.values())
