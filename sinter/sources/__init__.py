from sinter.sources import delimited, sinks

__all__ = ["delimited", "sinks"]
