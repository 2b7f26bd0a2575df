"""Pixel kernels against small scalar models and invariants."""

import numpy as np
import pytest

from folioflow.operators import images as im

RNG = np.random.default_rng(3)
PHOTO = RNG.integers(0, 256, (24, 30), dtype=np.uint8)


def test_threshold_and_otsu():
    assert (im.binarize(PHOTO, 127) == np.where(PHOTO > 127, 255, 0)).all()
    two = np.where(PHOTO > 100, 200, 20).astype(np.uint8)
    assert (im.otsu(two) == np.where(two > 100, 255, 0)).all()
    assert (im.otsu(two, inverted=True) == np.where(two > 100, 0, 255)).all()


def test_flat_images_stay_flat():
    flat = np.full((20, 20), 77, np.uint8)
    for f in (im.denoise, lambda x: im.denoise(x, "median"), lambda x: im.denoise(x, "bilateral"), im.sharpen, lambda x: im.upscale(x, 2, "lanczos"), lambda x: im.resize(x, 7, 9), im.deskew):
        assert (f(flat) == 77).all()
    assert not im.edges(flat).any()


def test_morphology_is_min_and_max():
    grown = im.morphology(PHOTO, "dilate")
    assert grown[5, 5] == PHOTO[4:7, 4:7].max()
    assert im.morphology(PHOTO, "erode")[5, 5] == PHOTO[4:7, 4:7].min()
    assert (im.morphology(PHOTO, "close") >= PHOTO).all()
    assert (im.morphology(PHOTO, "open") <= PHOTO).all()


def test_area_resize_is_block_mean():
    assert (im.resize(PHOTO, 15, 12) == np.rint(PHOTO.reshape(12, 2, 15, 2).mean(axis=(1, 3)))).all()


@pytest.mark.parametrize("method", ["nearest", "bilinear", "bicubic", "lanczos"])
def test_upscale_shapes(method):
    assert im.upscale(PHOTO, 3, method).shape == (72, 90)


def test_nearest_repeats_pixels():
    assert (im.upscale(PHOTO, 2, "nearest")[::2, ::2] == PHOTO).all()


def test_rectify():
    assert (im.rectify(PHOTO, [(0, 0), (1, 1)]) == PHOTO).all()
    corners = [(0, 0), (29, 0), (29, 23), (0, 23)]
    out = im.rectify(PHOTO, corners)
    assert out.shape == (23, 29)
    assert [out[0, 0], out[0, -1], out[-1, -1], out[-1, 0]] == [PHOTO[0, 0], PHOTO[0, 29], PHOTO[23, 29], PHOTO[23, 0]]


def test_rotation_by_a_quarter_and_back():
    assert (im.rotate(PHOTO, 0) == PHOTO).all()
    assert im.rotate(PHOTO, 90).shape in ((30, 24), (29, 24), (30, 23), (29, 23))


def test_a_failing_step_is_skipped():
    out, skipped = im.run_steps(PHOTO, [("binarization", {"adaptive": True}), ("grayscale_conversion", {}), ("brightness_adjustment", {"x": 1})])
    assert skipped == ["binarization"]
    assert (out == PHOTO).all()


def test_named_preprocessors():
    color = RNG.integers(0, 256, (40, 50, 3), dtype=np.uint8)
    assert im.national_id(color).shape == im.tax_card(color).shape == im.zone(color).shape == (40, 50, 3)
    assert im.passport(color).shape == (1, 256, 256, 3)
    assert set(np.unique(im.national_id(color))) <= {0, 255}
    assert im.smart_upscale(PHOTO).shape == (96, 120)
    assert im.upscale_with_fallback(PHOTO, 2).shape == (48, 60)
    for steps in im.PIPELINES.values():
        assert im.run_steps(color, steps)[1] == []


def test_neighbourhoods_against_single_pixels():
    """Sums over shifts give what a window around each pixel gives."""
    wide = np.pad(PHOTO, 2, mode="edge")
    assert im.denoise(PHOTO, "median")[7, 9] == np.median(wide[7:12, 9:14])
    assert (im.denoise(PHOTO, "median") == [[np.median(wide[y : y + 5, x : x + 5]) for x in range(30)] for y in range(24)]).all()
    mirrored = np.pad(PHOTO.astype(float), 4, mode="reflect")
    y, x = np.mgrid[-4:5, -4:5]
    near = mirrored[10:19, 12:21]
    weight = (y**2 + x**2 <= 16) * np.exp(-(y**2 + x**2) / (2 * 75**2) - (near - PHOTO[10, 12]) ** 2.0 / (2 * 75**2))
    assert abs(int(im.denoise(PHOTO, "bilateral")[10, 12]) - (weight * near).sum() / weight.sum()) <= 0.51


def test_memory_of_large_neighbourhoods():
    """A bilateral filter over 121 neighbours holds a few images, not 121."""
    import tracemalloc

    photo = RNG.integers(0, 256, (500, 500), dtype=np.uint8)
    tracemalloc.start()
    im.bilateral(photo, 11, 17, 17)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * photo.size * 4


def test_non_local_means():
    flat = np.full((30, 30), 100, np.uint8)
    assert (im.non_local_means(flat) == 100).all()
    noisy = np.clip(100 + RNG.normal(0, 4, (30, 30)), 0, 255).astype(np.uint8)
    noisy[:, 15:] += 80
    out = im.non_local_means(noisy, 10, 5, 11).astype(float)
    assert out[5:25, 3:10].std() < noisy[5:25, 3:10].std() / 1.5
    assert abs(out[5:25, 3:10].mean() - 100) < 2 and abs(out[5:25, 20:27].mean() - 180) < 2
    assert set(np.unique(im.adaptive(noisy))) <= {0, 255} and im.enhance(noisy).shape == (30, 30)


def test_crops_and_boxes():
    assert (im.crop(PHOTO, 3, 2, 8, 30) == PHOTO[2:24, 3:8]).all()
    assert im.crop(PHOTO, -5, -5, 2, 2).shape == (2, 2) and not im.crop(PHOTO, 9, 9, 4, 4).size and not im.crop(PHOTO, 40, 2, 50, 9).size
    assert im.region_ready(PHOTO).shape == (96, 120)
    assert im.region_ready(np.zeros((600, 500), np.uint8)).shape == (600, 500)
    assert im.region_ready(np.zeros((500, 300), np.uint8)).shape == (1000, 600)
    drawn = im.draw_box(np.zeros((40, 60, 3), np.uint8), 10, 15, 30, 35, label_size=(12, 4))
    assert (drawn[15, 20] == (0, 255, 0)).all() and (drawn[25, 10] == (0, 255, 0)).all() and not drawn[25, 20].any()
    assert (drawn[3, 15] == (0, 255, 0)).all() and not drawn[3, 40].any()


def test_document_corners():
    """A dark sheet, turned a little, on a light table is found and rectified; noise without an outline stays as it is."""
    table = np.full((160, 200), 220, np.uint8)
    y, x = np.mgrid[:160, :200]
    inside = (y > 30 + 0.05 * x) & (y < 120 + 0.05 * x) & (x > 40) & (x < 160)
    table[inside] = 40
    corners = im.document_corners(table)
    want = [(40, 32), (160, 38), (160, 128), (40, 122)]
    assert all(min(np.hypot(*(c - np.array(p))) for c in corners) < 4 for p in want)
    out = im.rectify(table)
    assert abs(out.shape[0] - 90) < 6 and abs(out.shape[1] - 120) < 6 and (out[5:-5, 5:-5] < 60).all()
    flat = np.full((40, 40), 9, np.uint8)
    assert im.rectify(flat) is flat


def test_png():
    from folioflow.sources import png

    color = RNG.integers(0, 256, (13, 17, 3), dtype=np.uint8)
    assert (png.rgb(png.encoded(color)) == color[..., ::-1]).all()
    assert (png.rgb(png.encoded(PHOTO)) == PHOTO[..., None]).all()
    assert (png.rgb(png.encoded(PHOTO / 255.0))[..., 0] == (PHOTO / 255.0 * 255).astype(np.uint8)).all()
    with pytest.raises(ValueError):
        png.rgb(b"no picture")
    with pytest.raises(ValueError):
        png.rgb(png.encoded(PHOTO)[:60])
    raw = PHOTO.astype(int)
    for kind in range(5):  # each filter undone
        lines = []
        for y in range(24):
            up, left = (raw[y - 1] if y else np.zeros(30, int)), np.append(0, raw[y][:-1])
            corner = np.append(0, up[:-1])
            to = np.abs(np.stack([up - corner, left - corner, left + up - 2 * corner]))
            paeth = np.where((to[0] <= to[1]) & (to[0] <= to[2]), left, np.where(to[1] <= to[2], up, corner))
            lines.append(bytes([kind]) + ((raw[y] - [np.zeros(30, int), left, up, (left + up) // 2, paeth][kind]) % 256).astype(np.uint8).tobytes())
        assert (png._unfiltered(b"".join(lines), 24, 30, 1) == PHOTO).all()
