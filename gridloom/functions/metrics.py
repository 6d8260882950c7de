"""Segmentation metrics and loss formulas as aggregate columns over pixel rows.

prob is the foreground probability, p the predicted and t the true class (0 or 1), w a pixel weight. An aggregate
belongs in groupBy(sample).agg(...); what the reference computes per batch is the mean over samples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

EPS = 1e-6


def _d(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("double")


def ratio(top: Column, below: Column, empty: float) -> Column:
    """top / below; empty where below is 0."""
    return F.when(below == 0, F.lit(empty)).otherwise(top / F.when(below == 0, F.lit(1.0)).otherwise(below))


def accuracy(p: str = "p", t: str = "t") -> Column:
    return F.avg((F.col(p) == F.col(t)).cast("int"))


def iou(p: str = "p", t: str = "t", absent: float = 1.0) -> Column:
    """Intersection over union; ``absent`` where both are empty."""
    both = F.sum(_d(p) * _d(t))
    return ratio(both, F.sum(_d(p) + _d(t)) - both, absent)


def dice(p: str = "p", t: str = "t", absent: float = 1.0) -> Column:
    return ratio(2 * F.sum(_d(p) * _d(t)), F.sum(_d(p) + _d(t)), absent)


def cover_error(p: str = "p", t: str = "t") -> Column:
    """Absolute difference of the covers; averaged later, it is not a root mean square."""
    return F.abs(F.avg(_d(p)) - F.avg(_d(t)))


def class_f1(p: Column, t: Column) -> Column:
    """F1 of a class given as two conditions, 0 where undefined."""
    hit, any_ = F.sum((p & t).cast("double")), F.sum(p.cast("double")) + F.sum(t.cast("double"))
    return ratio(2 * hit, any_, 0.0)


# ---- losses of one sample -------------------------------------------------------------------------------------------


def dice_loss(prob: str = "prob", t: str = "t") -> Column:
    """Two-class Dice loss with the one-hot target raised by EPS."""
    fg, truth = _d(prob), _d(t)
    bg = 1 - fg
    both = F.sum(fg * (truth + EPS) + bg * (1 - truth + EPS))
    total = F.sum(fg + bg + 1 + 2 * EPS)
    return 1 - 2 * both / (total + EPS)


def tversky_loss(alpha: float, beta: float, prob: str = "prob", t: str = "t") -> Column:
    """Two-class Tversky loss: over both classes, with the one-hot target raised by EPS."""
    fg, truth = _d(prob), _d(t)
    bg, one, zero = 1 - fg, truth + EPS, 1 - truth + EPS
    hit = F.sum(fg * one + bg * zero)
    wrong = F.sum(fg * (1 - one) + bg * (1 - zero))
    missed = F.sum((1 - fg) * one + (1 - bg) * zero)
    return 1 - hit / (hit + alpha * wrong + beta * missed + EPS)


def focal_tversky_loss(smooth: float = 1.0, alpha: float = 0.7, beta: float = 0.3, gamma: float = 4 / 3, prob: str = "prob", t: str = "t") -> Column:
    """Tversky on the flattened foreground, to a power."""
    hit = F.sum(_d(prob) * _d(t))
    wrong, missed = F.sum((1 - _d(t)) * _d(prob)), F.sum(_d(t) * (1 - _d(prob)))
    return F.pow(1 - (hit + smooth) / (hit + alpha * wrong + beta * missed + smooth), F.lit(gamma))


def soft_iou_loss(smooth: float = 1.0, prob: str = "prob", t: str = "t") -> Column:
    """Negated mean over both classes of the smoothed soft IoU."""

    def one(x: Column, y: Column) -> Column:
        hit = F.sum(x * y)
        return (hit + smooth) / (hit + F.sum(x * (1 - y)) + F.sum((1 - x) * y) + smooth)

    fg, truth = _d(prob), _d(t)
    return -(one(fg, truth) + one(1 - fg, 1 - truth)) / 2


def focal_loss(gamma: float = 2.0, smooth: float = 1e-5, alpha: tuple[float, float] = (1.0, 1.0), prob: str = "prob", t: str = "t") -> Column:
    """Mean focal loss: the target is clamped to [smooth, 1 - smooth] and pt = sum(target * prob) + smooth."""
    hot = F.when(_d(t) == 1, 1 - smooth).otherwise(smooth)
    cold = F.when(_d(t) == 1, smooth).otherwise(1 - smooth)
    pt = hot * _d(prob) + cold * (1 - _d(prob)) + smooth
    weight = F.when(_d(t) == 1, alpha[1]).otherwise(alpha[0])
    return F.avg(-weight * F.pow(1 - pt, F.lit(gamma)) * F.log(pt))


def _log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(1e-7)))


def cross_entropy(prob: str = "prob", t: str = "t") -> Column:
    return F.avg(-F.when(_d(t) == 1, _log(_d(prob))).otherwise(_log(1 - _d(prob))))


def weighted_cross_entropy(w0: float, prob: str = "prob", t: str = "t", w1: float = 0.0, label: str | None = None) -> Column:
    """Cross-entropy with additive weights: 1 + w0 on label 1, 1 + w1 on label 2, 1 elsewhere; labels above 1 are class 1."""
    name = F.col(label or t)
    weight = F.when(name == 1, 1 + w0).when(name == 2, 1 + w1).otherwise(1.0)
    truth = F.least(F.greatest(name, F.lit(0)), F.lit(1))
    return F.avg(-weight * F.when(truth == 1, _log(_d(prob))).otherwise(_log(1 - _d(prob))))


def bce(prob: str = "prob", t: str = "t", w: Column | None = None) -> Column:
    """Binary cross-entropy with probabilities kept inside (1e-7, 1 - 1e-7); w weights pixels."""
    x = F.least(F.greatest(_d(prob), F.lit(1e-7)), F.lit(1 - 1e-7))
    loss = -(_d(t) * F.log(x) + (1 - _d(t)) * F.log(1 - x))
    return F.avg(loss if w is None else loss * w)


def pixel_weighted_tversky(alpha: float, beta: float, w: Column, eps: float = 1e-6, prob: str = "prob", t: str = "t") -> Column:
    """1 - (hit + eps) / (hit + alpha wrong + beta missed + eps), each pixel weighted by w."""
    hit = F.sum(w * _d(prob) * _d(t))
    wrong, missed = F.sum(w * _d(prob) * (1 - _d(t))), F.sum(w * (1 - _d(prob)) * _d(t))
    return 1 - (hit + eps) / (hit + alpha * wrong + beta * missed + eps)


def soft_overlap_loss(kind: str = "dice", *, smooth: float = 1.0, background: bool = True, alpha: float = 0.3, beta: float = 0.7, square: bool = False, prob: str = "prob", t: str = "t") -> Column:
    """Negated mean over the classes of the smoothed soft overlap: dice, iou, or tversky with weights alpha of wrong and beta of
    missed. Without background the foreground alone counts. square: the three sums are of squared pixels. Grouped by sample
    it is the loss with sample axes; of a whole batch, that with batch axes."""
    if kind not in ("dice", "iou", "tversky"):
        raise ValueError("kind has to be dice, iou or tversky")

    def one(x: Column, y: Column) -> Column:
        add = lambda v: F.sum(v * v if square else v)
        hit, wrong, missed = add(x * y), add(x * (1 - y)), add((1 - x) * y)
        if kind == "dice":
            return (2 * hit + smooth) / (2 * hit + wrong + missed + smooth)
        a, b = (1.0, 1.0) if kind == "iou" else (alpha, beta)
        return (hit + smooth) / (hit + a * wrong + b * missed + smooth)

    fg, truth = _d(prob), _d(t)
    return -((one(fg, truth) + one(1 - fg, 1 - truth)) / 2 if background else one(fg, truth))


def focal_overlap_loss(power: float = 0.75, **options) -> Column:
    """1 - the soft Tversky overlap, to a power."""
    return F.pow(1 + soft_overlap_loss("tversky", **options), F.lit(power))


def dynamic_tversky(w: Column, cover: Column, alpha: float = 0.4, beta: float = 0.6, eps: float = 1e-6, prob: str = "prob", t: str = "t") -> Column:
    """The pixel-weighted Tversky loss to the power 1 / gamma, gamma being 1 + mean cover (in per cent) / 200."""
    return F.pow(pixel_weighted_tversky(alpha, beta, w, eps, prob, t), 1 / (1 + F.avg(cover) / 200))


def two_sided_tversky(w: Column, alpha: float = 0.5, beta: float = 0.5, gamma: float = 0.2, eps: float = 100.0, prob: str = "prob", t: str = "t") -> Column:
    """The pixel-weighted Tversky loss, and gamma times that of the complement: of truth, probability, the two weights, and the
    pixel weights, which count by their absolute value."""

    def loss(p: Column, y: Column, weight: Column, a: float, b: float) -> Column:
        weight = F.abs(weight)
        hit, wrong, missed = F.sum(weight * p * y), F.sum(weight * p * (1 - y)), F.sum(weight * (1 - p) * y)
        return 1 - (hit + eps) / (hit + a * wrong + b * missed + eps)

    p, y = _d(prob), _d(t)
    return loss(p, y, w, alpha, beta) + gamma * loss(1 - p, 1 - y, 1 - w, 1 - alpha, 1 - beta)


#: Losses by name: builders of aggregate columns.
LOSSES: dict[str, Callable[..., Column]] = {
    "dice": dice_loss,
    "tversky": lambda: tversky_loss(0.5, 0.5),
    "focal_tversky": focal_tversky_loss,
    "soft_iou": soft_iou_loss,
    "focal": focal_loss,
    "cross_entropy": cross_entropy,
    "bce": bce,
    "ce_plus_dice": lambda: cross_entropy() + dice_loss(),
    "weighted_ce": weighted_cross_entropy,
    "pixel_weighted_tversky": pixel_weighted_tversky,
    "soft_dice": soft_overlap_loss,
    "soft_tversky": lambda **options: soft_overlap_loss("tversky", **options),
    "focal_overlap": focal_overlap_loss,
    "dynamic_tversky": dynamic_tversky,
    "two_sided_tversky": two_sided_tversky,
}
