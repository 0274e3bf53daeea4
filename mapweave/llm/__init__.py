"""Training-data operators. Nothing outside this folder (but the guarded entry module and the corpus pipeline) imports it."""
