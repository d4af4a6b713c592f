"""An ordered key-value store as Spark computations over an append-only mutation log."""
