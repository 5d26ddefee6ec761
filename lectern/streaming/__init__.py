"""No streaming operators: the engine's inputs are whole files, and the alignment cursor lives within one of them."""
