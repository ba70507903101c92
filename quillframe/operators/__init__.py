"""The step operators: each takes a frame (a join two) and a step, and returns a lazy frame."""
