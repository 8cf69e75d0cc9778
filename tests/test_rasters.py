"""Components by tiles, merged boxes by sweeps, quantiles: against plain versions."""

import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from strataloom.operators import cases as K
from strataloom.operators import raster as X
from strataloom.operators import stats as S
from strataloom.operators import vision as V
from strataloom.sources.images import png_of, read_pixels, write_images


def brute_components(mask, least):
    left, out = set(mask), []
    while left:
        todo, own = [left.pop()], []
        while todo:
            image, x, y = todo.pop()
            own.append((x, y))
            for p in ((image, x + 1, y), (image, x - 1, y), (image, x, y + 1), (image, x, y - 1)):
                if p in left:
                    left.remove(p)
                    todo.append(p)
        if len(own) >= least:
            xs, ys = [x for x, _ in own], [y for _, y in own]
            out.append((image, min(xs), min(ys), max(xs), max(ys), len(own)))
    return sorted(out)


@pytest.mark.parametrize("tile, share", [(8, 0.55), (16, 0.62), (64, 0.6)])
def test_components(spark, tile, share):
    r = random.Random(tile)
    mask = {(i, x, y) for i in ("a", "b") for x in range(-20, 45) for y in range(-7, 40) if r.random() < share}
    mask |= {("spiral", x, 0) for x in range(60)} | {("spiral", 59, y) for y in range(60)} | {("spiral", x, 59) for x in range(60)} | {("spiral", 0, y) for y in range(3, 60)}
    rows = spark.createDataFrame(sorted(mask) + sorted(mask)[:5], "image string, x int, y int")
    assert sorted(map(tuple, X.components(rows, 3, tile).collect())) == brute_components(mask, 3)
    assert X.components(rows.limit(0)).count() == 0


def brute_merge(boxes, gap):
    """One box after the other joins the first that is near, which then takes in others from the first on."""
    near = lambda a, b: not (a[2] + gap < b[0] or b[2] + gap < a[0] or a[3] + gap < b[1] or b[3] + gap < a[1])
    unite = lambda a, b: (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4])
    done = []
    for box in boxes:
        at = next((i for i, b in enumerate(done) if near(b, box)), None)
        if at is None:
            done.append(box)
            continue
        done[at] = unite(done[at], box)
        while (other := next((i for i, b in enumerate(done) if i != at and near(done[at], b)), None)) is not None:
            done[at] = unite(done[at], done[other])
            del done[other]
            at -= other < at
    return sorted(done)


def test_merged_boxes(spark):
    rows, want = [], []
    for image, (n, size, most) in enumerate([(60, 400, 30), (300, 3000, 60), (40, 3000, 900), (1, 10, 5), (500, 1500, 8)]):
        r = random.Random(image)
        boxes = []
        for _ in range(n):
            x, y = r.randint(-50, size), r.randint(-50, size)
            boxes.append((x, y, x + r.randint(0, most), y + r.randint(0, most), r.randint(1, 9)))
        rows += [(image, *b) for b in boxes]
        want += [(image, *b) for b in brute_merge(boxes, 12)]
    got = V.merge_boxes(spark.createDataFrame(rows, "image int, x0 int, y0 int, x1 int, y1 int, pixels int"), 12)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_normal_quantile(spark):
    shares = [1e-12, 1e-6, 0.0001, 0.01, 0.02424, 0.02426, 0.3, 0.5, 0.7, 0.975, 0.97576, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(p,) for p in [*shares, 0.0, 1.0, -0.5, 2.0, None]], "p double").select("p", S.normal_quantile(F.col("p")).alias("z")).collect()
    got = {r.p: r.z for r in rows}
    for p in shares:
        assert abs(got[p] - NormalDist().inv_cdf(p)) < 1e-6 * max(1, abs(got[p]))
    assert all(got[p] is None for p in (0.0, 1.0, -0.5, 2.0, None))
    low, high = S.wilson_at(F.lit(8), F.lit(10), F.lit(0.95))
    a, b = S.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low, high, a, b).first()
    assert abs(r[0] - r[2]) < 1e-6 and abs(r[1] - r[3]) < 1e-6


def test_pixel_difference_of_image_files(spark, tmp_path):
    old = bytes((7 * x + y + c) % 256 for y in range(40) for x in range(50) for c in range(3))
    new = bytearray(old)
    for y in range(10, 14):
        for x in range(20, 30):
            new[3 * (50 * y + x)] ^= 128
    for side, data in (("old", old), ("new", bytes(new))):
        (tmp_path / side).mkdir()
        (tmp_path / side / "shot.png").write_bytes(png_of(50, 40, data))
        (tmp_path / side / "broken.png").write_bytes(b"no image")
    rows = {side: read_pixels(spark, str(tmp_path / side)) for side in ("old", "new")}
    assert sorted(tuple(r)[1:] for r in rows["old"].collect()) == sorted((x, y, *old[3 * (50 * y + x) : 3 * (50 * y + x) + 3]) for y in range(40) for x in range(50))
    r = X.pixel_diff(rows["old"], rows["new"]).first()
    assert (r.image, r.pixels, r.changed, r.changed_pct, r.passed) == ("shot", 2000, 40, 2.0, False)


def test_written_images_come_back(spark, tmp_path):
    rows = [(f"i{k}", x, y, k * 10, x, y) for k in range(3) for x in range(9) for y in range(7)]
    pixels = spark.createDataFrame(rows, "image string, x int, y int, r int, g int, b int")
    assert write_images(pixels, str(tmp_path / "out")).count() == 3
    assert sorted(map(tuple, read_pixels(spark, str(tmp_path / "out")).collect())) == sorted(rows)


def test_words_meet_regions(spark):
    r = random.Random(2)
    regions = [(i, k, r.randint(0, 900), r.randint(0, 600), r.randint(1, 400), r.randint(1, 300)) for i in range(2) for k in range(30)]
    words = [(i, k, r.randint(-20, 950), r.randint(-10, 650), r.randint(0, 60), r.randint(1, 20), f"w{k}", r.randint(0, 100) / 100) for i in range(3) for k in range(200)]
    got = V.words_in_regions(spark.createDataFrame(words, "image int, word_id int, x int, y int, width int, height int, text string, confidence double"), spark.createDataFrame(regions, "image int, region_id int, x int, y int, width int, height int"), 64)
    want = {}
    for i, k, x, y, w, h, text, c in words:
        mx, my = (2 * x + w) // 2, (2 * y + h) // 2
        own = [(b[4] * b[5], b[1]) for b in regions if b[0] == i and b[2] <= mx < b[2] + b[4] and b[3] <= my < b[3] + b[5]]
        if own:
            want.setdefault((i, min(own)[1]), []).append((y, x, k, text, c))
    assert {(r.image, r.region_id): (r.text, r.words) for r in got.collect()} == {k: (" ".join(x[3] for x in sorted(v)), len(v)) for k, v in want.items()}


def test_boxes_and_budget(spark):
    rows = spark.createDataFrame([(1, 10, 10, 20, 20), (2, 1900, 1070, 60, 60), (3, -50, -50, 10, 10), (4, 500, 500, 1, 1)], "image int, x int, y int, width int, height int")
    got = {r.image: tuple(r.b) for r in rows.select("image", V.expand_box((24, 24, 220, 140), F.lit(1920), F.lit(1080)).alias("b")).collect()}
    assert got == {1: (0, 0, 130, 90), 2: (1820, 1030, 100, 50), 3: (0, 0, 65, 25), 4: (391, 431, 220, 140)}
    nav = spark.createDataFrame([(1, 1, 1, True, 400), (1, 2, 2, True, 700), (1, 3, 3, True, 100), (1, 4, 4, False, 1), (2, 1, 1, False, 5), (2, 2, 2, False, 5)], "image int, region_id int, nav_rank int, include_by_default boolean, tokens long")
    assert sorted((r.image, r.region_id, r.spent) for r in V.within_budget(nav, 1000).collect()) == [(1, 1, 400), (2, 1, 5), (2, 2, 10)]
    assert sorted((r.image, r.region_id) for r in V.within_budget(nav, 5000, 1).collect()) == [(1, 1), (2, 1)]


def test_words_under_many_regions(spark, capsys):
    """Words and regions of one cell are not paired: 4,000 regions over 4,000 words made 16 million rows."""
    boxes = spark.range(4000).select(F.lit("i").alias("image"), F.col("id").alias("region_id"), (F.col("id") % 50).alias("x"), F.lit(0).alias("y"), (F.lit(60) + F.col("id") % 7).alias("width"), F.lit(100).alias("height"))
    words = spark.range(4000).select(F.lit("i").alias("image"), F.col("id").alias("word_id"), (F.col("id") % 90).alias("x"), (F.col("id") % 80).alias("y"), F.lit(4).alias("width"), F.lit(2).alias("height"), F.col("id").cast("string").alias("text"), F.lit(0.5).alias("confidence"))
    spots = words.select("image", (F.col("x") + 2).alias("mx"), (F.col("y") + 1).alias("my")).distinct()
    V.smallest_at(spots, boxes, 128).explain()
    assert "Join" not in capsys.readouterr().out
    want = {}
    for k in range(4000):
        own = [((60 + b % 7) * 100, b) for b in range(4000) if b % 50 <= k % 90 + 2 < b % 50 + 60 + b % 7]
        if own:
            want[min(own)[1]] = want.get(min(own)[1], 0) + 1
    assert {r.region_id: r.words for r in V.words_in_regions(words, boxes).collect()} == want


def test_near_boxes(spark, capsys):
    r = random.Random(9)
    rows = [(i, k, x, y, x + r.randint(0, 90), y + r.randint(0, 60)) for i in "ab" for k in range(120) for x, y in [(r.randint(-100, 700), r.randint(-80, 500))]]
    rows += [("a", 900 + k, 5, 5, 9, 9) for k in range(4)] + [("b", 990, -300, -300, 900, 900)]
    boxes = spark.createDataFrame(rows, "image string, box_id int, x0 int, y0 int, x1 int, y1 int")
    near = lambda p, q: p[0] == q[0] and p[1] < q[1] and p[2] - 20 <= q[4] and q[2] - 20 <= p[4] and p[3] - 20 <= q[5] and q[3] - 20 <= p[5]
    want = sorted((p[0], p[1], q[1]) for p in rows for q in rows if near(p, q))
    for cell in (None, 16, 300):
        assert sorted(map(tuple, K.near_boxes(boxes, cell=cell).collect())) == want
    assert K.near_boxes(boxes.limit(0)).count() == 0
    K.near_boxes(boxes).explain()
    assert "Broadcast" not in capsys.readouterr().out  # the tasks that read a small file would make all pairs
