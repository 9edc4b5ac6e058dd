"""Latent-field analytics on Spark: demand, capacity and utilization over a shared key, and what follows from them."""
