"""Types, predicates and scalar expressions of plans, as Spark columns."""
