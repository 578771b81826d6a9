"""splitlab: outcome-rate tables, effect estimates and leaderboards on Spark.

Every public function takes DataFrames and returns a DataFrame; nothing is
collected but model summaries and convergence norms.
"""

__version__ = "0.1.0"
