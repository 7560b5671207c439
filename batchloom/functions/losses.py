"""Softmax, losses and label encodings on array columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Log of softmax of ``logits / temperature``; the maximum is taken off first."""
    top = F.array_max(logits) / temperature
    shifted = F.transform(logits, lambda x: x / temperature - top)
    norm = F.log(total(F.transform(shifted, F.exp)))
    return F.transform(shifted, lambda x: x - norm)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    return F.transform(log_softmax(logits, temperature), F.exp)


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log probability of the label's class."""
    return -F.get(log_softmax(logits), label)


def soft_cross_entropy(logits: Column, target: Column, temperature: float = 1.0) -> Column:
    """Cross-entropy with a target distribution."""
    return -total(F.zip_with(log_softmax(logits, temperature), target, lambda x, t: x * t))


def kl_terms(logits: Column, teacher_logits: Column) -> Column:
    """Kullback-Leibler term of each class, from the teacher's distribution to the student's."""
    target = softmax(teacher_logits)
    return F.zip_with(target, log_softmax(logits), lambda t, x: F.when(t > 0, t * (F.log(t) - x)).otherwise(0.0))


def squared_error(value: Column, target: Column) -> Column:
    return (value - target) * (value - target)


def distill_loss(logits: Column, label: Column, teacher_logits: Column, weight: float, temperature: float | None) -> Column:
    """Weighted label and teacher loss of a row; average it over the rows.

    With a temperature the teacher loss is soft cross-entropy and the sum is scaled by its square,
    without one it is the mean Kullback-Leibler term over the classes.
    """
    hard = cross_entropy(logits, label)
    if temperature is None:
        return weight * hard + (1 - weight) * total(kl_terms(logits, teacher_logits)) / F.size(logits)
    soft = soft_cross_entropy(logits, softmax(teacher_logits, temperature), temperature)
    return temperature * temperature * (weight * hard + (1 - weight) * soft)


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1.0).otherwise(0.0))


def smooth_labels(encoded: Column, epsilon: float) -> Column:
    return F.transform(encoded, lambda y: (1 - epsilon) * y + F.lit(epsilon) / F.size(encoded))


def mixup(first: Column, second: Column, share: Column) -> Column:
    """Blend of two losses, or of two label vectors element by element."""
    return share * first + (1 - share) * second
