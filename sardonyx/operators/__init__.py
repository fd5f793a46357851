"""DataFrame -> DataFrame operators (cleaning, domains, ranking, encoding, metrics, scoring)."""
