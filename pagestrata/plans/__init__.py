"""Plans over whole corpora: benchmark, site index, usage figures."""
