"""Jobs of several steps: factorisations, solvers, generated systems, comparisons."""
