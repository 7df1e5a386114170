"""Plans of the engine: encoding of terms and compilation of formulas."""
