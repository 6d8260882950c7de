"""Array kernels by small hand-made cases and invariants."""

import numpy as np
from hypothesis import given, settings, strategies as st
from hypothesis.extra.numpy import arrays

from gridloom.operators import tiles

masks = arrays(bool, st.tuples(st.integers(1, 9), st.integers(1, 9)))


@given(masks)
@settings(max_examples=60, deadline=None)
def test_distance_is_the_nearest_unset_pixel(mask):
    got = tiles.distance_transform(mask)
    unset = np.argwhere(~mask)
    for y, x in np.ndindex(mask.shape):
        want = 0.0 if not mask[y, x] else np.sqrt(((unset - [y, x]) ** 2).sum(1).min()) if len(unset) else float(sum(mask.shape))
        assert abs(got[y, x] - want) < 1e-9


@given(masks)
@settings(max_examples=60, deadline=None)
def test_components_refine_the_mask(mask):
    label = tiles.components(mask)
    assert ((label > 0) == mask).all()
    down, right = mask[1:] & mask[:-1], mask[:, 1:] & mask[:, :-1]
    assert (label[1:][down] == label[:-1][down]).all() and (label[:, 1:][right] == label[:, :-1][right]).all()


@given(masks)
@settings(max_examples=60, deadline=None)
def test_watershed_covers_the_components_that_have_a_peak(mask):
    label = tiles.watershed(mask, 1, 1)
    assert not label[~mask].any()
    whole = tiles.components(mask)
    peaks = {int(whole[p]) for p in tiles.local_peaks(tiles.distance_transform(mask), mask, 1)}
    for k in np.unique(whole[whole > 0]):
        crown = label[whole == k]
        assert (crown > 0).all() if int(k) in peaks else not crown.any()
    for k in np.unique(label[label > 0]):
        assert len(np.unique(whole[label == k])) == 1


@given(masks)
@settings(max_examples=60, deadline=None)
def test_each_labelled_region_has_a_peak_of_its_own(mask):
    whole = tiles.components(mask)
    peaks = tiles.local_peaks(tiles.distance_transform(mask), whole, 1)
    assert {int(whole[p]) for p in peaks} == set(np.unique(whole[whole > 0]).tolist())


def test_one_label_lets_a_peak_suppress_another_component():
    mask = np.zeros((4, 5), bool)
    mask[2, 0] = mask[3, 1] = True
    distance = tiles.distance_transform(mask)
    assert tiles.local_peaks(distance, mask, 1) == [(2, 0)]
    assert tiles.local_peaks(distance, tiles.components(mask), 1) == [(2, 0), (3, 1)]
    assert tiles.watershed(mask, 1, 1)[2, 0] == 1 and tiles.watershed(mask, 1, 1)[3, 1] == 0
    cross = np.array([[0, 1, 0], [1, 1, 1], [0, 1, 0]])
    assert tiles.local_peaks(distance, mask, 0, cross) == [(2, 0), (3, 1)]


def test_bilinear_keeps_constants_and_size():
    assert np.allclose(tiles.bilinear(np.full((3, 5), 7.0), 6, 4), 7.0)
    assert tiles.bilinear(np.arange(12.0).reshape(3, 4), 3, 4).tolist() == np.arange(12.0).reshape(3, 4).tolist()


def test_rotate_by_a_right_angle_and_back():
    a = np.arange(25.0).reshape(5, 5)
    assert np.array_equal(tiles.rotate(tiles.rotate(a, 90), -90), a)
    assert np.array_equal(tiles.rotate(a, 90), np.rot90(a))


def test_polygon_mask_of_a_box_takes_pixel_centres():
    mask = tiles.polygon_mask([(1, 1), (4, 1), (4, 3), (1, 3)], 5, 5)
    assert mask.sum() == 6 and mask[1:3, 1:4].all()


def test_equalize_is_monotone():
    a = np.linspace(0, 1, 64).reshape(8, 8) ** 2
    for limit in (None, 2.0):
        assert (np.diff(tiles.equalize(a, 64, limit).ravel()) >= 0).all()


def test_peaks_near_a_side_can_be_left_out():
    mask = np.zeros((7, 9), bool)
    mask[0:3, 0:3] = mask[3:6, 5:8] = True
    distance = tiles.distance_transform(mask)
    assert tiles.local_peaks(distance, mask, 1) == [(0, 0), (4, 6)] and tiles.local_peaks(distance, mask, 1, border=1) == [(4, 6)]
    label = tiles.watershed(mask, 1, 1, border=1)
    assert label[4, 6] and not label[0, 0] and tiles.watershed(mask, 1, 1)[0, 0]
