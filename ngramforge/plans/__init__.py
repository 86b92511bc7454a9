"""Models: counts with the statistics that follow from them."""
