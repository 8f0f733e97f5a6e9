"""DataFrame-in, DataFrame-out analytic operators."""
