"""Column builders: uncertainty scores, predictions, reliability features and their transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)), without overflow for either sign."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def clipped(p: Column, eps: float = EPS) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = EPS) -> Column:
    q = clipped(p, eps)
    return F.log(q / (1 - q))


def msp_risk(p: Column) -> Column:
    return 1 - F.greatest(p, 1 - p)


def entropy_bits(p: Column) -> Column:
    q = clipped(p)
    return -(q * F.log2(q) + (1 - q) * F.log2(1 - q))


def symmetric_energy(score: Column, temperature: float = 1.0) -> Column:
    """-T * logsumexp([-s/2, s/2] / T)."""
    return -(F.abs(score) / 2 + temperature * F.log1p(F.exp(-F.abs(score) / temperature)))


def tempered_msp(score: Column, temperature: float) -> Column:
    if not 0 < temperature < float("inf"):
        raise ValueError("the temperature must be positive and finite")
    return msp_risk(sigmoid(score / temperature))


def predicted(p: Column, q: Column | float = 0.5) -> Column:
    return (p >= q).cast("int")


def base_error(prediction: Column, label: Column) -> Column:
    return (prediction != label).cast("int")


def accepted(risk: Column, threshold: Column) -> Column:
    """Fail closed: without a threshold nothing is accepted."""
    return F.coalesce(risk <= threshold, F.lit(False))


#: The policies by which groups are certified.
POLICIES = ("global_cp", "source_group_cp", "predicted_class_cp")


def policy_group(policy: str, source: Column, label: Column, prediction: Column) -> Column:
    """The group of a row under a policy: all rows; real rows and each generator's fakes; or the predicted class."""
    real = F.when(prediction == 0, "base_prediction_real").otherwise("base_prediction_fake")
    return {"global_cp": F.lit("global_all"), "source_group_cp": F.when(label == 0, "real_all").otherwise(F.lower(source)), "predicted_class_cp": real}[policy]


def nll(p: Column, y: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.log(q) + (1 - y) * F.log(1 - q))


# Reliability features of an orbit: z is an array of view logits, the identity view first.


def orientation(z0: Column, gamma: Column | float) -> Column:
    return F.when(z0 >= gamma, F.lit(1)).otherwise(F.lit(-1))


def margin_distance(z0: Column, gamma: Column | float) -> Column:
    return F.abs(z0 - gamma)


def array_mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b) / F.size(x)


def array_var_pop(x: Column) -> Column:
    m = array_mean(x)
    return F.aggregate(F.transform(x, lambda v: (v - m) * (v - m)), F.lit(0.0), lambda a, b: a + b) / F.size(x)


def erosions(z: Column, gamma: Column | float, views: int = 5) -> Column:
    """How far each other view moves towards the decision boundary."""
    c = orientation(F.element_at(z, 1), gamma)
    return F.transform(F.slice(z, 2, views - 1), lambda v: c * (F.element_at(z, 1) - v))


def boundary_margins(z: Column, gamma: Column | float) -> Column:
    """c * (z - gamma) of every view: how far it is on the identity view's side."""
    c = orientation(F.element_at(z, 1), gamma)
    return F.transform(z, lambda v: c * (v - gamma))


def checked_erosions(z: Column, gamma: Column | float, views: int = 5, tolerance: float = 1e-9) -> Column:
    """The erosions; an error where the margins tell another story."""
    direct, margins = erosions(z, gamma, views), boundary_margins(z, gamma)
    by_margin = F.transform(F.slice(margins, 2, views - 1), lambda m: F.element_at(margins, 1) - m)
    agree = F.forall(F.zip_with(direct, by_margin, lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    return F.when(agree, direct).otherwise(F.raise_error(F.lit("erosions and boundary margins disagree")))


def recovered_gamma(prediction: Column, z0: Column, margin: Column) -> Column:
    return F.when(prediction == 1, z0 - margin).otherwise(z0 + margin)


def unit(v: Column) -> Column:
    """v / ||v||; null where the norm is zero or not finite."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when((norm > 0) & (norm < float("inf")), F.transform(v, lambda x: x.cast("double") / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embedding_drift(views: Column) -> Column:
    """Mean of 1 - cosine between the first view and each other; views: array of unit vectors."""
    first = F.element_at(views, 1)
    return array_mean(F.transform(F.slice(views, 2, 1 << 20), lambda v: 1 - F.least(F.greatest(dot(v, first), F.lit(-1.0)), F.lit(1.0))))


TRANSFORMS = {
    "neg_log1p": lambda x: -F.log1p(F.greatest(x, F.lit(0.0))),
    "log1p": lambda x: F.log1p(F.greatest(x, F.lit(0.0))),
    "signed_log1p": lambda x: F.signum(x) * F.log1p(F.abs(x)),
}

#: The risk transform of each feature: a larger margin is less risk.
FEATURE_TRANSFORMS = {
    "margin_distance": "neg_log1p",
    "orbit_logit_variance": "log1p",
    "mean_directional_erosion": "signed_log1p",
    "worst_view_erosion": "signed_log1p",
}


def transformed(feature: str) -> Column:
    """The transformed feature; below -1e-6 an unsigned feature is an error, above it rounding."""
    kind, x = FEATURE_TRANSFORMS[feature], F.col(feature)
    out = TRANSFORMS[kind](x)
    return out if kind == "signed_log1p" else F.when(x < -1e-6, F.raise_error(F.lit(f"{feature} is negative"))).otherwise(out)


def zscored(x: Column, mean: float, scale: float) -> Column:
    if not scale > 0:
        raise ValueError("the scale must be positive")
    return (x - mean) / scale


def logistic_risk(features: list[Column], coefficients: list[float], intercept: float) -> Column:
    if len(features) != len(coefficients):
        raise ValueError("features and coefficients differ in number")
    z = F.lit(float(intercept))
    for x, c in zip(features, coefficients, strict=True):
        z = z + x * float(c)
    return sigmoid(z)


# Taxonomies.


def outcome_class(is_accepted: Column, error: Column) -> Column:
    return F.concat(F.when(is_accepted, "accepted_").otherwise("rejected_"), F.when(error == 1, "error").otherwise("correct"))


def bootstrap_category(is_accepted: Column, label: Column, prediction: Column, error: Column) -> Column:
    """What a resampled row counts as: rejected, or accepted as real, fake or other, in error or correct."""
    kind = (
        F.when((label == 0) & (prediction == 1), "real_error").when(label == 0, "real_correct").when((label == 1) & (prediction == 0), "fake_error")
        .when(label == 1, "fake_correct").when(error == 1, "other_error").otherwise("other_correct")
    )
    return F.when(is_accepted, F.concat(F.lit("accepted_"), kind)).otherwise("rejected")


def paired_category(source: Column, label: Column, prediction: Column, error: Column, first: Column, second: Column) -> Column:
    """group|label|prediction|error|accepted by the first method|by the second."""
    group = F.when(label == 0, "real_all").otherwise(source)
    return F.concat_ws("|", group, *[x.cast("int").cast("string") for x in (label, prediction, error, first, second)])


def near_threshold_bin(risk: Column, threshold: Column) -> Column:
    d = F.abs(risk - threshold)
    return (
        F.when(d.isNull(), "undefined").when(d <= 0.001, "0-0.001").when(d <= 0.005, "0.001-0.005").when(d <= 0.01, "0.005-0.01")
        .when(d <= 0.05, "0.01-0.05").otherwise("greater_than_0.05")
    )


def tags(conditions: dict[str, Column], many: str = "multi_factor", none: str = "none") -> Column:
    """The names of the conditions that hold, joined by |; a further one where there are several, or none."""
    found = F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in conditions.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.lit(none)).when(F.size(found) > 1, F.concat_ws("|", found, F.lit(many))).otherwise(F.concat_ws("|", found))
