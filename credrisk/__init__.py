"""credrisk: credit-risk analytics on Spark DataFrames.

Client records → checks and recodes → engineered features → profiles, group
rates, distributions, correlations → split / prepare / rebalance → MLlib
training and tuning → exact evaluation → leaderboard → batch and stream scoring
with risk tiers and factor explanations.
"""

__version__ = "0.1.0"
