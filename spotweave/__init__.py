"""Analytics over samples, spots and sparse per-spot gene counts, as Spark DataFrame operators."""
