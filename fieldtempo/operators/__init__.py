"""DataFrame operators: cleaning, pace, statistics, profiles, chart tables."""
