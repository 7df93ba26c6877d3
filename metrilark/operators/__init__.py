"""DataFrame operators: metrics, summaries, dataset shaping, few-shot sampling, pairwise comparison, chat turns."""
