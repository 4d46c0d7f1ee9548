"""DataFrame-to-DataFrame operators, meant for ``df.transform`` and each other."""
