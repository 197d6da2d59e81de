"""The analytic operators, as DataFrame-to-DataFrame functions."""
