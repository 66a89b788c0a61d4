"""Production parameters that queries and the pipeline share."""

#: Target weights of the sources that are named; all others share ``OTHER``.
TARGETS = {"src0": 2.0, "src1": 1.0, "src2": 1.0, "src3": 0.5}
OTHER = 6.0
