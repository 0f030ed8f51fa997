"""Line dedup holds one slice of its prefix words at a time, and its joins let few pairs through."""

import random

from lexiloom.llm import line_dedup


def similar(a, b):
    return 100 * len(a & b) >= 80 * len(a | b)


def test_slices(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 20)
    monkeypatch.setattr(line_dedup, "LEAST", 1, raising=False)
    rnd, sizes = random.Random(6), {}
    lines = [rnd.sample(range(400), 30) for _ in range(300)]
    lines += [rnd.sample(range(400), 3) + x[3:] for x in lines[::5]]
    save = line_dedup.Scratch.save

    def counted(run):
        def saved(self, df, name):
            out = run(self, df, name)
            sizes.setdefault(name, []).append(out.count())
            return out

        return saved

    monkeypatch.setattr(line_dedup.Scratch, "save", counted(save))
    monkeypatch.setattr(line_dedup.Scratch, "add", counted(getattr(line_dedup.Scratch, "add", save)), raising=False)
    text = [" ".join(f"w{i}" for i in x) for x in lines]
    got = {r.doc_id: r.n_removed for r in line_dedup.remove_similar_lines(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()}
    sets = [set(x) for x in lines]
    assert got == {i: int(any(similar(sets[i], sets[j]) for j in range(i))) for i in range(len(sets))}
    assert len(sizes["rows"]) == line_dedup.SLICES and max(sizes["rows"]) < sum(sizes["rows"]) / 2
    assert len(sizes["more"]) > line_dedup.SLICES + 1 and 0 < max(sizes["hot-words"]) and sizes["more"][-1] <= 10 * sum(got.values())
