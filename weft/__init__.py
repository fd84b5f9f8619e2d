"""Meta-path similarity analytics and corpus preparation on Spark."""
