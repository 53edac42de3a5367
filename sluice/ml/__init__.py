"""Learned operators: the block classifier, the tagger and the pace bandit's draws."""
