"""Preparation of training texts: the operators of the dealt problems and their queries."""
