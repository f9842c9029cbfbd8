"""Network algorithms, one network at a time inside a grouped plan, and whole plans built from them."""
