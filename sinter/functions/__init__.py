from sinter.functions import clean, metrics

__all__ = ["clean", "metrics"]
