"""Windows over pixel rows against the kernels that work on whole images."""

import numpy as np
import pytest

from veridex.raster import frames, kernels, pixels


def images(spark, *planes):
    rows = [(k, p.shape[1], p.shape[0], bytearray(kernels.from_plane(p).tobytes())) for k, p in enumerate(planes)]
    return spark.createDataFrame(rows, "image_id int, width int, height int, data binary")


def noisy(rng, h, w):
    y, x = np.mgrid[0:h, 0:w]
    return np.clip(90 + 60 * np.sin(y / 9) + 30 * np.cos(x / 5) + rng.normal(0, 20, (h, w)), 0, 255).astype(np.uint8)


def test_local_thresholds(spark):
    rng = np.random.default_rng(3)
    planes = [noisy(rng, 50, 70), noisy(rng, 9, 40), noisy(rng, 1, 1), np.full((33, 20), 7, np.uint8)]
    df = images(spark, *planes)
    for ours, kernel in ((pixels.adaptive_threshold, kernels.adaptive_threshold), (pixels.sauvola, kernels.sauvola), (pixels.niblack, kernels.niblack)):
        got = {r.image_id: r for r in pixels.raster(ours(pixels.pixels(df))).collect()}
        for k, p in enumerate(planes):
            want = kernel(kernels.from_plane(p))
            assert (got[k].height, got[k].width) == p.shape and bytes(got[k].data) == want.tobytes(), (ours.__name__, k)
    assert pixels.raster(pixels.niblack(pixels.pixels(df.limit(0)))).count() == 0


def test_otsu_from_counts(spark):
    rng = np.random.default_rng(4)
    planes = [noisy(rng, 40, 40), np.full((5, 5), 80, np.uint8)]
    got = {r.image_id: r.threshold for r in frames.otsu_levels(images(spark, *planes)).collect()}
    assert got == {k: kernels.otsu_level(p.astype(np.float64)) for k, p in enumerate(planes)}


def test_bands(spark):
    rng = np.random.default_rng(5)
    planes = [noisy(rng, h, 24) for h in (320, 500, 333, 21, 12)]
    planes[0][100:120] = rng.integers(0, 2, (20, 1)) * 255
    got = {r.image_id: (r.top, r.bottom) for r in pixels.roi_bands(pixels.pixels(images(spark, *planes))).collect()}
    for k, p in enumerate(planes):
        a, b = got[k]
        assert np.array_equal(kernels.from_plane(p)[a:b], kernels.auto_roi(kernels.from_plane(p))), k
    assert got[0] != (0, 320)


def test_regions(spark):
    rng = np.random.default_rng(6)
    planes = []
    for h, w in ((320, 96), (200, 64), (30, 90), (64, 64)):
        p = np.full((h, w), 200, np.uint8)
        for top in range(40, h - 30, 70):
            p[top : top + 24] = np.arange(w) % 2 * 255
        planes.append(p)
    planes.append(np.zeros((64, 64), np.uint8))
    for cell in (4, 8):
        got = {}
        for r in pixels.text_regions(pixels.pixels(images(spark, *planes)), cell).orderBy("image_id", "k").collect():
            got.setdefault(r.image_id, []).append((r.x, r.y, r.width, r.height))
        want = {k: b for k, p in enumerate(planes) if (b := kernels.text_regions(kernels.from_plane(p), cell))}
        assert got == want and want


def test_batches_of_rasters_are_small(spark):
    """What a step builds at once doesn't grow with the rows of a batch."""
    df = spark.range(1000).selectExpr("id AS vec_id", "array_repeat(0.5D, 64) AS embedding").coalesce(1)
    sizes = frames.grey_from_vectors(df).select("image_id", "data")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "2000"
    assert max(b.num_rows for b in frames._cut(sizes.toArrow().to_batches())) <= frames.AT_ONCE
    assert sizes.count() == 1000


def test_pixels_are_not_shuffled(spark):
    """Local thresholds make no row for a pixel; tall images are dealt once, as vectors, and their pixels stay where they are."""
    from tests.conftest import DATA
    from veridex.plans import catalog

    plan = lambda q: catalog.queries()[q](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    for q in ("raster_adaptive", "raster_sauvola", "raster_niblack"):
        assert "Window" not in plan(q) and "hashpartitioning" not in plan(q), q
    assert plan("raster_text_regions").count("hashpartitioning") == 1


def test_variants_come_in_batches(spark):
    df = images(spark, *[np.zeros((8, 8), np.uint8)] * 3)
    many = frames.with_variants(df.coalesce(1), ["original", "otsu"])
    sizes = many.mapInArrow(lambda bs: (b.slice(0, 1) for b in bs), many.schema)
    assert many.count() == 6 and sizes.count() == 1


def test_digests_of_variants(spark):
    """Digests are made where the pixels are; they are those of the pixels that with_variants gives."""
    rng = np.random.default_rng(7)
    df, names = images(spark, noisy(rng, 20, 33), noisy(rng, 1, 1)), ["original", "rotate_90", "sauvola", "upscale2x"]
    want = frames.with_variants(df, names).selectExpr("image_id", "variant", "width", "height", "sha2(data, 256) AS sha256", "crc32(data) AS crc32").orderBy("image_id", "variant").collect()
    for digest in ("sha256", "crc32"):
        got = frames.variant_digests(df, names, digest).orderBy("image_id", "variant").collect()
        assert [tuple(r) for r in got] == [(r.image_id, r.variant, r.width, r.height, r[digest]) for r in want]
    assert frames.variant_digests(df.limit(0), names, "crc32").count() == 0


def test_one_python_step_for_rasters(spark):
    """Rasters are made by expressions, so that executors hold Python workers for one step only, and pixels don't come back from it."""
    from tests.conftest import DATA
    from veridex.plans import catalog

    for q in ("raster_adaptive", "raster_sauvola", "raster_niblack", "raster_variants"):
        plan = catalog.queries()[q](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "sha2(" not in plan and "crc32(" not in plan, q


def test_rasters_of_vectors(spark):
    vectors = np.random.default_rng(8).normal(0, 2, (3, 6))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id int, embedding array<double>")
    assert [f.dataType.simpleString() for f in frames.grey_from_vectors(df, side=2).schema] == ["int", "int", "int", "binary"]
    for r in frames.grey_from_vectors(df.selectExpr("vec_id", "slice(embedding, 1, 4) AS embedding"), side=2, scale=3).collect():
        g = (np.abs(vectors[r.image_id][:4]) * 255).astype(np.int64) % 256
        assert (r.width, r.height) == (6, 6) and bytes(r.data) == kernels.upscale(kernels.from_plane(g.reshape(2, 2)), 3).tobytes()
    with pytest.raises(Exception, match="a vector of 6 values"):
        frames.grey_from_vectors(df, side=2).collect()


def test_grey_pixels_and_windows():
    """Values are clamped and rounded to even whatever their type, and windows are cut at the border."""
    for p in (np.array([[-3.0, 0.5, 1.5, 300]]), np.array([[-3, 0, 2, 300]]), np.array([[0, 0, 2, 255]], np.uint8)):
        assert kernels.from_plane(p).tolist() == [[[0, 0, 0, 255], [0, 0, 0, 255], [2, 2, 2, 255], [255, 255, 255, 255]]]
    for h, w, half in ((40, 9, 15), (3, 50, 2), (1, 1, 15)):
        p = np.random.default_rng(9).integers(0, 256, (h, w)).astype(float)
        total, n = kernels.window_sums(p, half)
        for y in range(h):
            for x in range(w):
                part = p[max(0, y - half) : y + half + 1, max(0, x - half) : x + half + 1]
                assert (total[y, x], n[y, x]) == (part.sum(), part.size)


def test_pixels_are_ordered_once(spark):
    """What a task holds of its pixels: one sort; sizes of images, densities and bands are found from cells."""
    shown = pixels.pixels(images(spark, np.zeros((8, 8), np.uint8))).repartition(2, "image_id")
    plan = pixels.cell_edges(shown, 2)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("HashAggregate") :]
    assert below.count("Sort [") == 1 and below.count("Window") == 1


def test_edges_of_whole_cells(spark):
    """Cells cut by the border don't count; those without a pixel in an even row and column, as odd ones of cells of one pixel, don't come out."""
    p = np.random.default_rng(10).integers(0, 3, (7, 5)).astype(np.uint8)
    differs = np.append(p.ravel()[1:] != p.ravel()[:-1], False).reshape(p.shape)
    for cell in (1, 2, 3, 4):
        want = {}
        for y in range(0, 7 // cell * cell, 2):
            for x in range(0, 5 // cell * cell, 2):
                want[y // cell, x // cell] = want.get((y // cell, x // cell), 0) + int(differs[y, x])
        assert {(r.cy, r.cx): r.n for r in pixels.cell_edges(pixels.pixels(images(spark, p)), cell).collect()} == want
